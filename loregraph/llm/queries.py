"""The registered queries of the operators, one for each, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm.common import table


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.media import copy_groups, rendered_vectors

    return copy_groups(rendered_vectors(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "image_id")


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents"))


def op6_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.lines import line_counts

    return line_counts(table(spark, sf_dir, "documents"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.chat import rendered

    return rendered(table(spark, sf_dir, "conversations"))


def _part(column: str, salt: str):
    """A number from 0 to 65535 that depends on the column alone, the same in Spark and in SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(column))), 1, 4), 16, 10).cast("int")


def dated_list(pages: DataFrame) -> DataFrame:
    """A list with history from the hosts of pages: (pattern, action, day). Sites are listed, some leave, some come back;
    so do the first steps of their paths."""
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    site = F.array_join(F.slice(F.split(host, "[.]"), F.greatest(F.size(F.split(host, "[.]")) - 2, F.lit(1)), 3), ".")
    path = F.concat(site, F.lit("/"), F.regexp_extract("url", "://[^/]+/([^/?#]+)", 1))
    names = pages.select(F.explode(F.array(site, path)).alias("pattern")).where("pattern not like '%/'").distinct()
    start = F.date_add(F.lit("2024-01-01").cast("date"), _part("pattern", "b") % 300)
    listed = names.where(_part("pattern", "a") % 3 == 0).select("pattern", start.alias("d"), (1 + _part("pattern", "c") % 90).alias("n"), (_part("pattern", "d") % 4).alias("k"))
    left = F.date_add("d", F.col("n"))
    return (
        listed.select("pattern", F.lit("add").alias("action"), F.col("d").alias("day"))
        .union(listed.where("k < 3").select("pattern", F.lit("remove"), left))
        .union(listed.where("k < 1").select("pattern", F.lit("add"), F.date_add(left, 30)))
    )


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.ngram_lm import scores

    out = scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 6).alias("mean_score"))


def op9_dated_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.urllist import evaluated

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), _part("url", "t") % 366)
    return evaluated(pages.select(F.col("page_id").alias("id"), "url", day.alias("day")), dated_list(pages)).withColumnRenamed("id", "page_id").withColumn("day", F.col("day").cast("string"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; its root recomputed with the line ends gone from every second text."""
    from loregraph.llm.merkle import folds, leaves

    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    return folds(leaves(table(spark, sf_dir, "documents"), altered)).withColumnRenamed("id", "doc_id").drop("grp")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of `conversations`, each rebuilt to begin with some turns of the one of which its number is a neighbour."""
    from loregraph.llm.trie import placed_turns, prefix_trie, rebuilt

    conv = F.col("conv")
    head = (F.crc32(conv.cast("string").cast("binary")) % 9).cast("int")
    turns, convs = rebuilt(placed_turns(table(spark, sf_dir, "conversations")), head, conv - conv % 5, 8)
    return prefix_trie(turns, convs)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text of `documents`, as digests."""
    import public_tokenizers

    from loregraph.llm.tokens import decoded, digests, encoded

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(decoded(encoded(table(spark, sf_dir, "documents"), path, pattern), path, pattern))


_OPERATORS = (
    op1_importance_resampling,
    op2_image_copies,
    op3_string_tiling,
    op4_pivotal_mixing,
    op5_fuzzy_lines,
    op6_string_kernel_language,
    op7_chat_snapshots,
    op8_stupid_backoff,
    op9_dated_url_list,
    op10_ngram_jaccard,
    op11_merkle_manifest,
    op12_prefix_trie,
    op13_byte_bpe,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
SQL: dict[str, str] = {}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

SQL["op10_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT DISTINCT x, x FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
m AS (SELECT x, min(y) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.m, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""

SQL["op9_dated_url_list"] = r"""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host, regexp_extract(url, '://[^/]+/([^/?#]+)', 1) AS step,
      regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
      DATE '2024-01-01' + (('0x' || substr(md5('t' || url), 1, 4))::INT % 366) AS day FROM pages),
s AS (SELECT *, string_split(host, '.') AS l FROM h),
site AS (SELECT *, array_to_string(l[greatest(len(l) - 2, 1):], '.') AS site FROM s),
names AS (SELECT DISTINCT site AS pattern FROM site UNION SELECT DISTINCT site || '/' || step FROM site WHERE step <> ''),
n AS (SELECT pattern, ('0x' || substr(md5('a' || pattern), 1, 4))::INT AS a, ('0x' || substr(md5('b' || pattern), 1, 4))::INT AS b,
      ('0x' || substr(md5('c' || pattern), 1, 4))::INT AS c, ('0x' || substr(md5('d' || pattern), 1, 4))::INT AS d FROM names),
e AS (SELECT pattern, DATE '2024-01-01' + b % 300 AS since, 1 + c % 90 AS len, d % 4 AS k FROM n WHERE a % 3 = 0),
i AS (SELECT lower(pattern) AS pattern, since, CASE WHEN k < 3 THEN since + len END AS until FROM e
      UNION ALL SELECT lower(pattern), since + len + 30, NULL FROM e WHERE k < 1),
k AS (SELECT page_id, day, unnest(list_concat(list_transform(range(1, greatest(len(l), 2)), lambda j: array_to_string(l[j:], '.')),
      list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1),
      lambda j: host || '/' || lower(array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:j], '/'))))) AS pattern FROM s),
m AS (SELECT k.page_id, arg_max(k.pattern, (length(k.pattern), k.pattern)) AS entry FROM k JOIN i ON i.pattern = k.pattern AND k.day >= i.since AND (i.until IS NULL OR k.day < i.until) GROUP BY 1)
SELECT s.page_id, CAST(s.day AS VARCHAR) AS day, m.entry IS NOT NULL AS blocked, m.entry FROM s LEFT JOIN m USING (page_id)
"""

SQL["op7_chat_snapshots"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t),
c AS (SELECT conv_id, count(*) AS n, list(role || chr(1) || text ORDER BY place) AS turns FROM o GROUP BY 1),
u AS (SELECT turns, n, min(conv_id) AS conv_id FROM c GROUP BY 1, 2),
k AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > u.n AND c.turns[1] = u.turns[1] AND c.turns[1:u.n] = u.turns))
SELECT o.conv_id, CAST((o.place - 1) // 64 AS BIGINT) AS segment, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM o JOIN k USING (conv_id) GROUP BY 1, 2
"""

SQL["op8_stupid_backoff"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT count(*) AS n FROM p), c1 AS (SELECT w, count(*) AS c FROM p GROUP BY 1),
c2 AS (SELECT v, w, count(*) AS c FROM x WHERE v IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT u, v, w, count(*) AS c FROM x WHERE u IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT x.doc_id, x.u, x.v, t.c AS t, b.c AS b, h.c AS h, a.c AS a, g.c AS g, ln(a.c) - ln(n.n) AS low
      FROM x CROSS JOIN n JOIN c1 a ON a.w = x.w LEFT JOIN c1 g ON g.w = x.v LEFT JOIN c2 b ON b.v = x.v AND b.w = x.w
      LEFT JOIN c2 h ON h.v = x.u AND h.w = x.v LEFT JOIN c3 t ON t.u = x.u AND t.v = x.v AND t.w = x.w),
m AS (SELECT *, CASE WHEN v IS NULL THEN low WHEN b >= 2 THEN ln(b) - ln(g) ELSE ln(0.4) + low END AS mid FROM l),
s AS (SELECT doc_id, sum(CASE WHEN u IS NULL THEN mid WHEN t >= 2 THEN ln(t) - ln(h) ELSE ln(0.4) + mid END) AS s, count(*) AS k FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(s.k, 0)::BIGINT AS n_words, round(s.s, 4) AS log_score, round(s.s / s.k, 6) AS mean_score FROM d LEFT JOIN s USING (doc_id)
"""

#: Unsigned crc32 of a decimal number: its table, and the sum over the digits of a string.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t)"


def _crc(digits: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _leaf(text: str) -> str:
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    return f"sha256({' || '.join(one(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_SIBLINGS = "coalesce(string_agg(h, '') OVER (PARTITION BY {0}k, pos // 3 ORDER BY pos ROWS BETWEEN {1}), '')"

SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")} AS changed
  FROM (SELECT *, coalesce({_crc('doc_id::VARCHAR')} % 2 = 0, false) AS even FROM documents, crc) x),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM d),
l AS (SELECT source, 0 AS k, pos, leaf AS h, m FROM n UNION ALL SELECT source, k + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(m) + 2) // 3 FROM l WHERE m > 1 GROUP BY source, k, pos // 3),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM l WHERE m = 1),
r AS (SELECT 0 AS k, pos, subroot AS h, m FROM s UNION ALL SELECT k + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(m) + 2) // 3 FROM r WHERE m > 1 GROUP BY k, pos // 3),
a AS (SELECT source, k, pos, {_SIBLINGS.format("source, ", "UNBOUNDED PRECEDING AND 1 PRECEDING")} AS before, {_SIBLINGS.format("source, ", "1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS after FROM l WHERE m > 1),
b AS (SELECT k, pos, {_SIBLINGS.format("", "UNBOUNDED PRECEDING AND 1 PRECEDING")} AS before, {_SIBLINGS.format("", "1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS after FROM r WHERE m > 1),
f AS (SELECT doc_id, source, leaf, pos AS own, 0 AS k, pos, m, changed AS now, '' AS proof FROM n
  UNION ALL SELECT f.doc_id, f.source, f.leaf, f.own, f.k + 1, f.pos // 3, (f.m + 2) // 3, sha256(a.before || f.now || a.after), f.proof || a.before || a.after
  FROM f JOIN a ON a.source IS NOT DISTINCT FROM f.source AND a.k = f.k AND a.pos = f.pos WHERE f.m > 1),
g AS (SELECT f.doc_id, f.leaf, s.subroot, 0 AS k, s.pos, s.m, f.now, f.proof FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE f.m = 1
  UNION ALL SELECT g.doc_id, g.leaf, g.subroot, g.k + 1, g.pos // 3, (g.m + 2) // 3, sha256(b.before || g.now || b.after), g.proof || b.before || b.after FROM g JOIN b ON b.k = g.k AND b.pos = g.pos WHERE g.m > 1)
SELECT g.doc_id, g.leaf, g.subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.now AS folded_root, g.now = r.h AS verified FROM g JOIN r ON r.m = 1 WHERE g.m = 1
"""

SQL["op12_prefix_trie"] = f"""
WITH {_CRC_TABLE},
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, r, t, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, t) AS i FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations) x),
k AS (SELECT c, {_crc('c::VARCHAR')} % 9 AS h, c - c % 5 AS p FROM ids, crc),
n AS (SELECT c, count(*) AS n FROM o GROUP BY 1),
b AS (SELECT k.c, o.i AS d, r, t FROM k JOIN o ON o.c = k.p AND o.i <= k.h
  UNION ALL SELECT k.c, o.i - k.h + least(k.h, coalesce(n.n, 0)), r, t FROM k JOIN o ON o.c = k.c AND o.i > k.h LEFT JOIN n ON n.c = k.p),
x AS (SELECT c, d, md5(string_agg(strlen(r) || ':' || r || strlen(t) || ':' || t, '') OVER (PARTITION BY c ORDER BY d)) AS key, strlen(t) AS n FROM b UNION ALL SELECT c, 0, '', 0 FROM ids),
m AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM x GROUP BY 1, 2),
p AS (SELECT m.*, q.key AS up FROM m LEFT JOIN x q ON q.c = m.conv_id AND q.d = m.d - 1),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM p WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN kids USING (d, key)),
sub AS (SELECT a.d, a.key, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.n) AS saved FROM w JOIN x a ON a.c = w.conv_id AND a.d <= w.d GROUP BY 1, 2),
e AS (SELECT d, key, string_agg(c::VARCHAR, ',' ORDER BY c) AS e FROM x JOIN (SELECT c, max(d) AS d FROM x GROUP BY 1) l USING (c, d) GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, sub.n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.e, '')) AS ends_sha256
FROM w JOIN sub USING (d, key) LEFT JOIN e USING (d, key) LEFT JOIN m u ON u.d = w.d - 1 AND u.key = w.up
"""
