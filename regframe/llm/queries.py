"""The registered queries of the operators and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.llm import chat, debruijn, decontaminate, jaccard, langid, mixing, pii, quality, repeats, resample, secrets, trie, wrapper
from regframe.llm.common import table

#: Conversation that every formatting run holds besides the table's: control strings in texts.
TRICKY = r"\### Assistant: </turn> ok"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = secrets.KINDS[:3]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        *counts[:3],
        F.sha2(secrets.as_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.as_text(secrets.KINDS).alias("spans"),
        counts[3],
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("posterior", 6).alias("posterior"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.train(docs))
    return got.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.remove(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS escaped,
         lead(role) OVER w AS next_role, lag(role) OVER w AS last_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + length(' </turn>') + 1 + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10
      WHEN 'assistant' THEN 15 ELSE 11 + length(role) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN last_role IS NULL WHEN 'user' THEN last_role IS NULL OR last_role <> 'user'
      WHEN 'assistant' THEN last_role IS NOT DISTINCT FROM 'user' ELSE false END
    AND (next_role IS NOT NULL OR role = 'assistant')) AS valid
FROM turns GROUP BY conv_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0), lambda a, r: a + r["end"] - r["start"]).cast("long")
    return hits.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP6_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
pats AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
dw AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (
  SELECT dw.r, dw.i, p.n, p.item FROM (SELECT DISTINCT n FROM pats) AS k
  JOIN dw ON dw.i + k.n - 1 <= len(dw.w)
  JOIN pats p ON p.n = k.n AND p.s = array_to_string(dw.w[dw.i:dw.i + k.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT r, item FROM occ WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return pii.scan(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        *[n(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.as_text("base").cast("binary"), 256).alias("base_sha256"),
        pii.as_text("spans").alias("spans"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: ``{docs}`` is the table mixed; also used by the pipeline's last stage.
MIX_CTES = r"""
mix_d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM {docs}),
mix_s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
  FROM mix_d GROUP BY source),
mix_o AS (
  SELECT *, sum(source_size) OVER () AS total, 3 * source_size AS cap,
    coalesce(sum(3 * source_size) OVER w, 0) AS caps,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM mix_s WINDOW w AS (ORDER BY 3.0 * source_size / weight, encode(source) NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix_c AS (SELECT *, cap * rest <= (total - caps) * weight AS capped FROM mix_o),
mix_t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight / CAST(sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target
  FROM mix_c),
mix_p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM mix_t),
mix_h AS (
  SELECT source, h, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto, words
  FROM (SELECT source, h, sum(size) AS words FROM mix_d GROUP BY source, h)),
mix_e AS (
  SELECT h.source, h.h, p.source_size, p.target, p.epochs,
    p.target - p.epochs * p.source_size AS budget, h.upto, h.words,
    h.upto <= p.target - p.epochs * p.source_size AS inside
  FROM mix_h h JOIN mix_p p ON h.source IS NOT DISTINCT FROM p.source),
mix_f AS (
  SELECT *, NOT inside AND row_number() OVER (PARTITION BY source, inside ORDER BY h) = 1
    AND upto - budget < budget - (upto - words) AS edge FROM mix_e),
mix AS (
  SELECT d.doc_id, d.source, CAST(d.size AS BIGINT) AS size, f.source_size, f.target,
    CAST(d.size * (f.epochs + CASE WHEN (f.inside OR f.edge) AND f.budget > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
  FROM mix_d d JOIN mix_f f ON d.h = f.h AND d.source IS NOT DISTINCT FROM f.source)
"""
OP8_SQL = "WITH " + MIX_CTES.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, taken FROM mix"

def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


#: Links and components over ``{docs}`` (doc_id, text); also used by the pipeline.
JACCARD_CTES = r"""
jac_w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM {docs}),
jac_i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM jac_w WHERE len(w) > 0),
jac_s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM jac_i),
jac_n AS (SELECT doc_id, count(*) AS n FROM jac_s GROUP BY doc_id),
jac_p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM jac_s a JOIN jac_s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
jac_l AS (
  SELECT a, b FROM jac_p JOIN jac_n x ON x.doc_id = a JOIN jac_n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
jac_r(a, b) AS (SELECT doc_id, doc_id FROM jac_w UNION SELECT r.a, l.b FROM jac_r r JOIN jac_l l ON r.b = l.a),
jac AS (
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
  FROM jac_w w JOIN jac_r r ON r.a = w.doc_id LEFT JOIN jac_n n ON n.doc_id = w.doc_id GROUP BY ALL)
"""
OP9_SQL = "WITH RECURSIVE " + JACCARD_CTES.replace("{docs}", "documents") + "SELECT * FROM jac"

def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = wrapper.extract(table(spark, sf_dir, "pages"))
    return got.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def shared_starts(convs: DataFrame) -> DataFrame:
    """Conversation c begins with the first crc32(c) % 6 turns of conversation c - c % 100,
    its own turns from there on follow."""
    base = convs.where("conv_id % 100 = 0").selectExpr("conv_id AS base", "substring(digests, 1, 80) AS first", "slice(chars, 1, 5) AS first_chars")
    cut = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).join(base, F.expr("conv_id - conv_id % 100 = base"), "left")
    return cut.selectExpr(
        "conv_id",
        "concat(coalesce(substring(first, 1, cast(16 * h AS int)), X''), substring(digests, cast(16 * h AS int) + 1, octet_length(digests))) AS digests",
        "concat(coalesce(slice(first_chars, 1, cast(h AS int)), array()), slice(chars, cast(h AS int) + 1, size(chars))) AS chars",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(shared_starts(trie.steps(table(spark, sf_dir, "conversations"))))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, hash(text)) AS r,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
seen AS (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM win),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 20)) AS j FROM seen WHERE k > 1)),
ws AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (
  SELECT ws.r, count(*) AS n, string_agg(x, ' ' ORDER BY ws.j) AS t
  FROM ws ANTI JOIN gone ON gone.r = ws.r AND gone.j = ws.j GROUP BY ws.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


#: Unsigned CRC-32 of hexadecimal digits, two a byte: one table step a half byte, the
#: lower half first. The table holds the 16 steps of the standard polynomial (fixed values).
_SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
  list_transform(range(1, length({hex}) + 1), lambda i: CAST(strpos('0123456789ABCDEF', substr({hex}, i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END, 1)) - 1 AS BIGINT))),
  lambda c, n: xor(([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
    3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(c, n) & 15) + 1], c >> 4)))"""
OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(k := k, n := n) ORDER BY turn NULLS FIRST, role, k) AS l FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, l, {_SQL_CRC.replace("{hex}", "x")} % 6 AS h FROM (SELECT *, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM own)),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
pre AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM built),
mem AS (SELECT conv_id, l, d, array_to_string(list_transform(l[1:d], lambda x: x.k), ',') AS p FROM pre),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(l[1:d]) AS l,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(l) = d), '')) AS ends_sha256
  FROM mem GROUP BY p, d),
tree AS (
  SELECT *, array_to_string(list_transform(l[1:d - 1], lambda x: x.k), ',') AS up,
    (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE l[d].n END AS saved FROM node),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM tree WHERE d > 0 GROUP BY ALL),
full_tree AS (SELECT t.*, coalesce(k.n, 0) AS n_children FROM tree t LEFT JOIN kids k ON k.up = t.p AND k.d = t.d),
above AS (SELECT n_children, saved, l, unnest(range(0, d + 1)) AS a FROM full_tree),
sums AS (
  SELECT array_to_string(list_transform(l[1:a], lambda x: x.k), ',') AS p, a AS d,
    CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY ALL)
SELECT t.conv_id, t.d AS depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens, t.ends_sha256
FROM full_tree t JOIN sums s ON s.p = t.p AND s.d = t.d LEFT JOIN tree u ON t.d > 0 AND u.p = t.up AND u.d = t.d - 1
"""
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce({_SQL_WORDS}, []) AS w FROM benchmark),
df AS (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
hexes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
buckets AS (SELECT f, {_SQL_CRC.replace("{hex}", "x")} % 10000 AS b FROM hexes),
s AS (SELECT b, count(*) AS s FROM df JOIN buckets USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bf JOIN buckets USING (f) GROUP BY b),
gain AS (
  SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM df) + 10000)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM bf) + 10000)))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (b)),
weights AS (
  SELECT r, count(*) AS n_features, CAST(floor(sum(g) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight
  FROM df JOIN buckets USING (f) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
      / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY fit) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_repeats": op4_repeats,
    "op5_chat_format": op5_chat_format,
    "op6_decontaminate": op6_decontaminate,
    "op7_pii": op7_pii,
    "op8_mix_sources": op8_mix_sources,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_extract": op10_html_extract,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_resample": op13_resample,
}
SQL = {"op5_chat_format": OP5_SQL, "op6_decontaminate": OP6_SQL, "op8_mix_sources": OP8_SQL,
    "op9_jaccard_join": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_substring_dedup": OP12_SQL,
    "op13_resample": OP13_SQL,
}
