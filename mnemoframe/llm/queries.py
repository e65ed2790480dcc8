"""The numbered operators as queries over the driver's tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import conversation, cotraining, decontamination, langid, linededup, njaccard, packing, repetition, secretscan, toxicity, urlfilter, warc, whitening
from mnemoframe.llm.common import table

ID_CLASS = "pmod(crc32(cast(doc_id as string)), {})"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), f"{ID_CLASS.format(4)} <> 2", f"{ID_CLASS.format(4)} = 2")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return njaccard.near_duplicates(table(spark, sf_dir, "documents"))


def derived_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and dated list entries made from ``pages`` by a rule, since the tables hold neither: see OP8_SQL."""
    day = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(day, F.expr("cast(page_id * 37 % 366 as int)")).alias("fetched_at"))
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("h"), urlfilter.path_of(F.col("url")).alias("p")).where("h <> ''")
    named = [
        hosts.select(F.lit("domain").alias("kind"), F.col("h").alias("pattern")),
        hosts.where("instr(h, '.') > 0").select(F.lit("domain").alias("kind"), F.expr("substring(h, instr(h, '.') + 1)").alias("pattern")),
        hosts.select(F.lit("prefix").alias("kind"), F.lower(F.concat("h", F.lit("/"), F.split("p", "/")[1])).alias("pattern")).where("pattern is not null"),
    ]
    patterns = named[0].unionAll(named[1]).unionAll(named[2]).distinct().withColumn("m", F.md5("pattern"))
    rows = patterns.withColumn("list", F.expr("if(substring(m, 1, 1) < '4', 'allow', 'block')")).withColumn("start", F.expr("cast(conv(substring(m, 3, 2), 16, 10) as int)"))
    steps = rows.where("substring(m, 2, 1) < 'a'").select("list", "kind", "pattern", F.explode(F.expr("array(struct('add' as action, start as d), struct('remove' as action, start + 60 as d), struct('add' as action, start + 120 as d))")).alias("s"))
    return captures, steps.select("list", "kind", "pattern", "s.action", F.date_add(day, F.col("s.d")).alias("dated"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(*derived_lists(table(spark, sf_dir, "pages").select("page_id", "url")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), f"{ID_CLASS.format(5)} <> 0", f"{ID_CLASS.format(5)} = 0")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), f"{ID_CLASS.format(3)} <> 1", f"{ID_CLASS.format(3)} = 1")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation.repair_report(rows, conversation.damaged(rows))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.find_secrets(table(spark, sf_dir, "documents")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_benchmark_decontamination": op1,
    "op2_quality_rules": op2,
    "op3_line_dedup": op3,
    "op4_best_fit_packing": op4,
    "op5_language_id": op5,
    "op6_warc": op6,
    "op7_ngram_jaccard_join": op7,
    "op8_url_filters": op8,
    "op9_quality_classifier": op9,
    "op10_toxicity": op10,
    "op11_conversation_repair": op11,
    "op12_secret_scan": op12,
    "op13_embedding_whitening": op13,
}

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
l AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to FROM l
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w WHERE ws IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
c AS (SELECT v, min(u) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id
"""

OP8_SQL = r"""
WITH u AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS DATE) AS fetched_at,
  lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages),
c AS (SELECT page_id, url, fetched_at, h, p, count(*) AS n_captures FROM u GROUP BY ALL),
pat AS (SELECT DISTINCT 'domain' AS kind, h AS pattern FROM u WHERE h <> ''
  UNION SELECT 'domain', substring(h, instr(h, '.') + 1) FROM u WHERE instr(h, '.') > 0
  UNION SELECT 'prefix', lower(h || '/' || string_split(p, '/')[2]) FROM u WHERE h <> '' AND string_split(p, '/')[2] IS NOT NULL),
m AS (SELECT kind, pattern, md5(pattern) AS m FROM pat),
a AS (SELECT kind, pattern, CASE WHEN substring(m, 1, 1) < '4' THEN 'allow' ELSE 'block' END AS list, CAST('0x' || substring(m, 3, 2) AS INT) AS start FROM m WHERE substring(m, 2, 1) < 'a'),
i AS (SELECT list, kind, pattern, start AS f, start + 60 AS t FROM a UNION ALL SELECT list, kind, pattern, start + 120, NULL FROM a),
k AS (SELECT page_id, url, fetched_at, n_captures, 'domain' AS kind, unnest(list_transform(range(1, len(string_split(h, '.')) + 1), lambda x: array_to_string(string_split(h, '.')[x:], '.'))) AS pattern FROM c WHERE h <> ''
  UNION ALL SELECT page_id, url, fetched_at, n_captures, 'prefix', unnest(list_transform(range(0, len(list_filter(string_split(p, '/'), lambda x: x <> '')) + 1),
    lambda x: lower(h || '/' || array_to_string(list_filter(string_split(p, '/'), lambda y: y <> '')[1:x], '/')))) FROM c WHERE h <> ''
  UNION ALL SELECT page_id, url, fetched_at, n_captures, NULL, NULL FROM c WHERE coalesce(h, '') = ''),
j AS (SELECT k.*, i.list FROM k LEFT JOIN i ON i.kind = k.kind AND i.pattern = k.pattern AND k.fetched_at >= DATE '2024-01-01' + i.f AND (i.t IS NULL OR k.fetched_at < DATE '2024-01-01' + i.t)),
g AS (SELECT page_id, url, fetched_at, n_captures, count(*) FILTER (list = 'block') AS n_block, count(*) FILTER (list = 'allow') AS n_allow,
  coalesce(max(length(pattern)) FILTER (list = 'block'), 0) AS block_length, coalesce(max(length(pattern)) FILTER (list = 'allow'), 0) AS allow_length FROM j GROUP BY ALL)
SELECT *, n_block > 0 AND allow_length < block_length AS blocked FROM g
"""



def op11_sql() -> str:
    """The least (cost, audit) of each state, row by row, in a recursion; DuckDB has no crc32, so its table is made of the polynomial."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda j: ord(k[j])::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    more = lambda s, cost, letter, line="''": f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {s}.o || {line}}} END"
    least = lambda *xs: f"list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))[1]"
    insert = lambda role, *states: [more(s, 3, "I", f"chr(10) || '{role}:'") for s in states]
    keep = lambda sign, s: f"CASE WHEN lower(code) = '{sign}' THEN {more(s, 'late', 'K', 'chr(10) || r || chr(58) || t')} END"
    rerole = lambda role, s: f"CASE WHEN code <> 'x' THEN {more(s, '3 + late', 'R', f"chr(10) || '{role}:' || t")} END"
    gone = lambda s: more(s, 4, "D")
    closed = lambda source: f"SELECT *, {least('s3', *insert('assistant', 'f2'))} AS f3 FROM (SELECT *, {least('s2', *insert('user', 's0', 's1', 's3'))} AS f2 FROM {source})"
    start = "{'c': 0, 'a': '', 'o': ''}"
    none = "NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR)"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t0, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (SELECT conv_id, turn, r, t0, {crc} % 20 AS deal FROM k, (SELECT {table} AS t)),
d AS (SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE r END AS r, CASE WHEN deal = 1 THEN '' WHEN deal = 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS t, unnest(CASE WHEN deal = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE deal <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(t), copy) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(t, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, r, t ORDER BY i) > 1 AS again,
  regexp_extract(t, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(r, 1) AS pair FROM n),
e AS (SELECT *, CASE WHEN blank OR again THEN 'x' ELSE left(r, 1) END AS code, CASE WHEN NOT blank AND NOT again AND cut THEN 3 ELSE 0 END AS late FROM f),
g AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (late = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id),
p AS (SELECT conv_id, 0::BIGINT AS at, {start} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM g
  UNION ALL SELECT conv_id, i, {gone("s0")}, {least(gone("s1"), keep("s", "s0"))}, {least(gone("f2"), *[x for s in ("s0", "s1", "f3") for x in (keep("u", s), rerole("user", s))])}, {least(gone("f3"), keep("a", "f2"), rerole("assistant", "f2"))}
  FROM ({closed("(SELECT p.*, e.i, e.r, e.t, e.code, e.late FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.at + 1)")})),
w AS (SELECT p.*, g.* EXCLUDE (conv_id) FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.rows = p.at),
b AS (SELECT * EXCLUDE (s0, s1, s2, s3, f2, f3), {least("s0", "f3")} AS b FROM ({closed("w")}))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost,
  coalesce(b.b.a, '') AS audit, sha256(coalesce(substring(b.b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_sql() -> str:
    """Each text with a match is cut into the rule's matches and single characters, whose running length says where a match begins."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cut = "SELECT doc_id, {k} AS k, {kind} AS kind, piece, {group} AS value, pos FROM (SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS pos FROM (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {cutter}) AS ps FROM d WHERE regexp_matches(text, {pattern})))) WHERE length(piece) > 1"
    rules = [cut.format(k=k, kind=quoted(r.kind), cutter=quoted(f"(?:{r.pattern})|(?s:.)"), pattern=quoted(r.pattern), group=f"regexp_extract(piece, {quoted(r.pattern)}, {r.group})") + f" AND length(value) >= {r.least}" for k, r in enumerate(secretscan.RULES)]
    base = ", ".join(quoted(r.kind) for r in secretscan.BASE_RULES)
    counts = ", ".join(f"count(s.kind) FILTER (s.kind = {quoted(r.kind)}) AS n_{r.kind}" for r in secretscan.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(rules)}),
l AS (SELECT doc_id, kind, k, pos, kind || ':' || pos || ':' || (pos + length(piece)) AS span FROM s)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY pos, k) FILTER (s.kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY pos, k), '') AS spans
FROM d LEFT JOIN l s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLE_SQL = {"op6_warc": OP6_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_url_filters": OP8_SQL, "op11_conversation_repair": op11_sql(), "op12_secret_scan": op12_sql()}
