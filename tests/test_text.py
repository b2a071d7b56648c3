from loregraph.functions import text as T


# Words too common to tell a person by.
WEAK = [
    "alexandrovna", "and", "brother", "captain", "daughter", "elder", "father", "fyodorovitch", "her", "his", "ivanovna", "karamazov", "karamazovs", "lady", "little", "madame", "monk", "mother", "old",
    "pavlovitch", "sister", "son", "the", "their", "young",
]


def test_whitespace_and_quotes(one):
    assert one(T.flat, " a \n\t b\xa0c ", "", None) == ["a b c", "", None]
    assert one(T.norm_quote, "“It’s”  —\nA–B") == ['"it\'s" - a-b']


def test_names(one):
    assert one(T.clean, "a\x00b \x1fc", " x ") == ["a b c", "x"]
    assert one(T.norm, "The Old Man's house", "Alyosha’s", "An.", "Miüsov, P.", "half-brother", "the the x", "") == ["old man house", "alyosha", "an", "miüsov p", "half-brother", "the x", ""]
    assert one(T.has_upper, "abc", "aBc", "Émile", "") == [False, True, True, False]


def test_tokens(one):
    assert one(T.tokens, "Été 12 a-b 가나", "") == [["été", "12", "a", "b", "가나"], []]
    assert one(lambda c: T.key_tokens(c, WEAK), "Captain Snegiryov", "the Captain", "It is", "Dmitri Karamazov") == [["snegiryov"], ["the", "captain"], [], ["dmitri"]]


def test_roman(one):
    assert one(T.roman_to_int, "I", "IV", "IX", "XIV", "XL", "XCIX", "IIX", "") == [1, 4, 9, 14, 40, 99, 8, None]
