"""The registered queries of this subpackage: each operator over its whole table, with its SQL twin where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metframe.catalog.base import Query
from metframe.llm import alignment, ann, chat, decontaminate, licenses, lm, minmax, packing, rtree, spelling, toxicity, urls, warc
from metframe.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.with_roles(_table(spark, sf_dir, "pages"), "page_id", "url", "html", min_bytes=1000)
    folder = warc.archive_folder(spark)
    written = materialize(warc.write_archives(rows, f"{folder}/crawl"), "warc-written")
    normalised = materialize(warc.normalise(written, f"{folder}/members"), "warc-normalised")
    found = warc.read_records(normalised)
    return found.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


_OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
d AS (SELECT payload_digest, max(page_id) AS response_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1),
r AS (SELECT p.*, coalesce(d.response_id, p.page_id) <> p.page_id AS again, d.response_id FROM p LEFT JOIN d USING (payload_digest))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN response_id END AS refers_to FROM r
"""


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), F.round("score", 6).alias("score"),
    )


_POSTINGS = licenses.postings([*licenses.BASE, *licenses.LIBRARY], len(licenses.BASE))
_OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS words FROM documents),
p(template, label, base, word, place, mandatory) AS (VALUES {', '.join(f"({x.template}, '{x.label}', {x.base}, '{x.word}', {x.place}, {x.mandatory})" for x in _POSTINGS)}),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM d),
f AS (SELECT word, count(DISTINCT rid) AS df FROM w WHERE word IN (SELECT word FROM p) GROUP BY 1),
t AS (SELECT p.*, coalesce(df, 0) AS df, ln((SELECT count(*) + 1 FROM documents) / (coalesce(df, 0) + 1)) + 1 AS weight,
  count(*) OVER (PARTITION BY template) AS length FROM p LEFT JOIN f USING (word)),
r AS (SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY df, word) AS rare, count(*) OVER (PARTITION BY template) AS n
  FROM (SELECT DISTINCT template, word, df FROM t)),
k AS (SELECT t.*, r.rare <= ceil(r.n / 3) AS anchor FROM t JOIN r USING (template, word)),
x AS (SELECT *, sum(weight) OVER (PARTITION BY template) AS total, sum(CAST(mandatory AS INTEGER)) OVER (PARTITION BY template) AS needed
  FROM k WHERE mandatory OR anchor),
m AS (SELECT rid, template, w.place - x.place AS start, any_value(label) AS label, any_value(base) AS base, any_value(length) AS length,
  sum(weight) / any_value(total) AS coverage
  FROM w JOIN x USING (word) GROUP BY 1, 2, 3
  HAVING sum(CAST(mandatory AS INTEGER)) = any_value(needed) AND bool_or(anchor) AND sum(weight) / any_value(total) >= {licenses.MIN_COVERAGE}),
a AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(coverage * length / (length + {licenses.SCORE_WORDS})) AS score FROM m GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(CAST(coalesce(score, 0) AS DOUBLE), 6) AS score FROM d LEFT JOIN a USING (rid)
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _held_out(column: str, parts: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % parts == 2


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_held_out("doc_id", 7), F.lit(False))
    model = lm.fit(documents.where(~held_out))
    scored = lm.score(documents, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~_held_out("doc_id", 4))
    scored = toxicity.score(documents, toxicity.fit(documents, labels))
    return scored.select(
        "doc_id", _held_out("doc_id", 4).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = materialize(chat.format_chats(turns.unionByName(own)), "chat-windows")
    return chat.read_back(windows)


RULES = [
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(_table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", F.array_join("soft_terms", ",").alias("soft_terms"))


def _has(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _count(term: str) -> str:
    """Bounded places of a term; neighbours may share the character between them, so it is doubled first."""
    return f"len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){term}([^a-z0-9]|$)'))"


def _fits(rule: urls.Rule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r.text))
_OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
h AS (SELECT page_id, u, regexp_extract(u, '://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
t AS (SELECT *, CAST({' + '.join(map(_count, urls.STRICT_TERMS))} AS INTEGER) AS strict_hits,
  list_filter([{', '.join(f"CASE WHEN {_has(t)} THEN '{t}' END" for t in sorted(urls.SOFT_TERMS))}], lambda x: x IS NOT NULL) AS soft,
  CASE {' '.join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _LONGEST)} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r.text}' THEN '{r.action}'" for r in RULES)}
  WHEN strict_hits > 0 OR len(soft) >= 2 THEN 'block' ELSE 'allow' END AS verdict, strict_hits, array_to_string(soft, ',') AS soft_terms FROM t
"""

def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op12_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.near_classes(_table(spark, sf_dir, "documents"), words=5, percent=80)


def _jaccard_sql(words: int, more: str = "") -> str:
    """Classes of documents whose sets of shingles meet the threshold of 80 percent: common shingles are counted pair by pair."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words} - 1], ' ')) END) AS x FROM d),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z y ON y.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * o >= 80 * (y.n + v.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id{more}
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


_OP13_SQL = """
WITH RECURSIVE k AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT run, doc_id, n, hex(encode(concat(doc_id, ':', run))) AS h FROM g),
x AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS BIGINT))),
  lambda a, v: xor(a >> 8, crc[(xor(a, v) & 255) + 1])), 4294967295) AS h FROM b, k),
w AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM x GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
d AS (SELECT DISTINCT word, n, concat(substr(word, 1, i), substr(word, i + 2)) AS cut, i FROM w, unnest(range(length(word))) AS t(i)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM w a JOIN d b ON a.word = b.cut
  UNION SELECT b.word, b.n, a.word, a.n FROM w a JOIN d b ON a.word = b.cut),
f AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, struct_pack(l := -m, o := other)) AS best, max(m) AS best_n FROM p GROUP BY 1),
t AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
z AS (SELECT word, word AS root FROM t UNION ALL SELECT z.word, t.form FROM z JOIN t ON t.word = z.root WHERE t.form IS NOT NULL),
q AS (SELECT z.word, z.root FROM z JOIN t ON t.word = z.root WHERE t.form IS NULL)
SELECT t.word, t.n, CAST(t.n_near AS BIGINT) AS n_near, t.form, CAST(t.form_n AS BIGINT) AS form_n, q.root FROM t JOIN q USING (word)
"""

QUERIES = [
    Query("op1_warc", op1_warc, _OP1_SQL),
    Query("op2_licenses", op2_licenses, _OP2_SQL),
    Query("op3_decontaminate", op3_decontaminate),
    Query("op4_ann", op4_ann),
    Query("op5_minmax", op5_minmax, _jaccard_sql(2, ", coalesce(m.root, d.doc_id) = d.doc_id AS kept")),
    Query("op6_packing", op6_packing),
    Query("op7_lm", op7_lm),
    Query("op8_toxicity", op8_toxicity),
    Query("op9_chat", op9_chat),
    Query("op10_urls", op10_urls, _OP10_SQL),
    Query("op11_alignment", op11_alignment),
    Query("op12_rtree", op12_rtree, _jaccard_sql(5)),
    Query("op13_spelling", op13_spelling, _OP13_SQL),
]
