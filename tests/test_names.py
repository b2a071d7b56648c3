from loregraph.operators import names as N

# Words that make an alias a description rather than a name.
DESCRIPTIVE = [
    "boy", "brother", "called", "captain", "daughter", "elder", "father", "girl", "half", "her", "herself", "himself", "his", "lady", "little", "madame", "mamma", "man", "monk", "mother", "my", "named",
    "old", "our", "papa", "same", "servant", "sister", "son", "that", "the", "their", "this", "woman", "young", "younger",
]

GROUPS = [("Old Karl Berg", "Karl", 0), ("Old Karl Berg", "the old Berg", 1), ("Mary Stone", "Mary", 2), ("Mary Stone", "Karl", 3)]


def dicts(spark, groups=GROUPS):
    return N.Dicts(
        N.alias_dict(spark.createDataFrame(groups, "canon string, variant string, ord int")),
        spark.createDataFrame([("the monastery",), ("boy",), ("the boy",)], "name string"),
        spark.createDataFrame([("monastery", "the Monastery"), ("moscow", "Moscow")], "name string, canon string"),
        spark.createDataFrame([("zorn", "Father Zorn", 0), ("stone", "Mary Stone", 1)], "token string, canon string, ord int"),
        spark.createDataFrame([("berg",)], "token string"),
    )


def test_alias_dict(spark):
    got = {r.key: r.canon for r in dicts(spark).aliases.collect()}
    assert got == {"old karl berg": "Old Karl Berg", "karl": "Mary Stone", "old berg": "Old Karl Berg", "mary stone": "Mary Stone", "mary": "Mary Stone"}


def test_resolve(spark):
    want = {
        None: None, "": None, " ": None, "the": "Xx", "the monastery": None, "Monastery": "the Monastery", "The boy": None, "a boy": None, "Karl’s": "Mary Stone", "Zorn Stone": "Father Zorn",
        "Zorn Berg": "Zorn Berg", "somebody": None, "Some\tBody": "Some Body", "...": None, "MOSCOW": "Moscow",
    }
    del want["the"]
    df = spark.createDataFrame([(k, 1) for k in want] + [("Karl’s", 2)], "name string, n int")
    got = N.resolve(df, "name", dicts(spark)).collect()
    assert len(got) == len(want) + 1 and {r.name: r.resolved for r in got} == want


MENTIONS = [
    ("c", "p1", "d1", 0, "Mary Stone", ["Stone Mary", "Berg", "Nobody", "boy", "mary", "small"]),
    ("c", "p1", "d1", 1, "Old Karl Berg", ["Stone Mary", "Karl Berg the Elder"]),
    ("c", "p1", "d2", 0, "Karl Berg the Elder", ["Karl Senior"]),
    ("c", "p2", "d1", 0, "nobody at all", ["Karl X"]),
]


def test_learned_aliases(spark):
    df = spark.createDataFrame(MENTIONS, "corpus_id string, pass string, doc_id string, ent_pos int, name string, aliases array<string>")
    accepted, rejected = N.learn_aliases(df, dicts(spark))
    want = {"stone mary": "Mary Stone", "karl berg the elder": "Old Karl Berg", "karl senior": "Old Karl Berg"}
    assert {r.key: r.canon for r in accepted.collect()} == want
    assert {(r.alias, r.reason) for r in rejected.collect()} == {("Berg", "surname only"), ("Nobody", "no overlap")}
    assert scan(df, dicts(spark)) == want


def scan(entities, dicts):
    """The scan in run order, by plain loops: {key: canon}."""
    from pyspark.sql import functions as F

    from loregraph.functions.text import has_upper, norm, words

    rows = N.resolve(entities, "name", dicts, "canon").select("pass", "doc_id", "ent_pos", "canon", norm(F.col("name")).alias("own"), words(norm(F.col("canon"))).alias("parts"), F.posexplode("aliases").alias("pos", "alias"))
    rows = rows.withColumn("key", norm(F.col("alias"))).withColumn("upper", has_upper(F.col("alias"))).orderBy("pass", "doc_id", "ent_pos", "pos").collect()
    of = lambda df, c: {r[c] for r in df.collect()}
    fixed, stop, shared = of(dicts.aliases, "key"), of(dicts.stop, "name"), of(dicts.shared, "token")
    known = fixed | stop | of(dicts.places, "name")
    learned = {}
    for r in rows:
        canon, parts = learned[r.own] if r.own in learned and r.own not in known else (r.canon, {w for w in r.parts or () if len(w) > 2})
        words_ = set(r.key.split())
        if canon and r.key and r.upper and r.key not in stop | fixed | set(learned) and not words_ <= shared and words_ & parts:
            learned[r.key] = (canon, parts)
    return {k: c for k, (c, _) in learned.items()}


def test_aliases_of_two_corpora(spark):
    rows = [("a", "p", "d", 0, "Mary Stone", ["Stone X"]), ("b", "p", "d", 0, "Karl Stone", ["Stone X"]), ("b", "p", "d", 1, "Stone X", ["Stone Y"])]
    df = spark.createDataFrame(rows, "corpus_id string, pass string, doc_id string, ent_pos int, name string, aliases array<string>")
    d = N.Dicts(*[x.where("false") for x in (dicts(spark).aliases, dicts(spark).stop, dicts(spark).places, dicts(spark).surnames, dicts(spark).shared)])
    got = {(r.corpus_id, r.key): r.canon for r in N.learn_aliases(df, d)[0].collect()}
    assert got == {("a", "stone x"): "Mary Stone", ("b", "stone x"): "Karl Stone", ("b", "stone y"): "Karl Stone"}


def test_aliases_learned_through_a_long_chain(spark):
    rows = [("c", "p1", "d1", i, f"Root X{i}", [f"Root X{i + 1}"]) for i in range(26)]
    df = spark.createDataFrame(rows, "corpus_id string, pass string, doc_id string, ent_pos int, name string, aliases array<string>")
    want = scan(df, dicts(spark))
    assert want == {f"root x{i + 1}": "Root X0" for i in range(26)}
    assert {r.key: r.canon for r in N.learn_aliases(df, dicts(spark))[0].collect()} == want


def test_votes(spark):
    rows = [("c", "p1", "d", 0, "A", "X"), ("c", "p1", "d", 1, "A", "Y"), ("c", "p1", "d", 2, "B", "X"), ("c", "p1", "d", 3, "B", "Y"), ("c", "p2", "d", 0, "B", "Y"), ("c", "p2", "d", 1, None, "Y")]
    got = N.vote_types(spark.createDataFrame(rows, "corpus_id string, pass string, doc_id string, ent_pos int, name string, type string"))
    assert {r.name: r.type for r in got.collect()} == {"A": "X", "B": "Y"}


def test_first_seen_and_labels(spark):
    s = spark.createDataFrame([("c", "a", 1, "Karla and the old\nBerg"), ("c", "b", 2, "KARL's old Berg"), ("c", "d", 3, "karl")], "corpus_id string, doc_id string, global_index int, text string")
    nodes = spark.createDataFrame([("c", "Old Karl Berg", "Character"), ("c", "Mary Stone", "Place")], "corpus_id string, id string, type string")
    d = dicts(spark, GROUPS[:3]).aliases
    got = {r.alias: (r.first_index, r.display) for r in N.alias_first_seen(d, nodes, s, DESCRIPTIVE).collect()}
    assert got == {"karl": (2, True), "old berg": (1, False)}
    t = spark.createDataFrame([("A", "R", "B")], "subject string, relation string, object string")
    lab = lambda *x: spark.createDataFrame(x, "id string, label string")
    assert N.with_labels(t, lab(("A", "α")), lab(("R", "ρ"))).first().line == "α ─[ρ]→ B"


def test_each_form_is_looked_for_in_each_corpus(spark, tmp_path):
    """A name that one source's documents give is found in those of the others."""
    from loregraph.plans import registry

    rows = [(0, "Barnaby met nobody", "a"), (1, "then barnaby left with Cassandra", "b"), (2, "no one", "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.corpus_id, x.form) for x in registry.text_search(spark, str(tmp_path)).collect()}
    assert got == {("a", "barnaby"), ("b", "barnaby"), ("b", "cassandra")}


def test_runs_that_are_no_form_stay_where_they_are(spark):
    """Every form passes the filter, few other runs do, and what is found is what the texts hold."""
    import numpy as np

    from loregraph.operators import graph

    forms = spark.createDataFrame([("c", f"k{i}", f"name é{i}" if i % 2 else f"word{i}") for i in range(3000)], "corpus_id string, key string, form string")
    filled = graph._filled(forms.withColumnRenamed("form", "_run"))
    held = lambda runs: (filled[(at := graph._cells(runs)) >> 3] >> (at & 7) & 1).sum()
    assert filled.dtype == np.uint8 and held([r.form for r in forms.collect()]) == 3000
    assert held([f"other{i} word" for i in range(10_000)]) < 20
    s = spark.createDataFrame([("c", n, n, f"A word{2 * n}, the Name  É{2 * n + 1} and word{2 * n + 1}") for n in range(40)], "corpus_id string, doc_id int, global_index int, text string")
    assert {(r.form, r.doc_id) for r in graph.find_forms(forms, s).collect()} == {x for n in range(40) for x in ((f"word{2 * n}", n), (f"name é{2 * n + 1}", n))}
