"""The named queries of the operators, and check SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, lm, mixing, neardup, outliers, quality, repair, runs, secrets, vectordup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB, bit by bit."""
    return (f"(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({text}) + 1), lambda i: ascii({text}[i])::BIGINT)), "
            "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT))")


@query
def op4_source_mix(spark, sf_dir):
    """Weights 1, 2, 3 repeating over the sources, at most three times a source."""
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op8_minhash_near_dedup(spark, sf_dir):
    """Groups of documents whose shingle sets overlap by 75 %."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_benchmark_decontamination(spark, sf_dir):
    """Documents that hold 75 % of a benchmark item's shingles."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# joins every document shingle with the item shingles on the words themselves
ORACLES["op5_benchmark_decontamination"] = r"""WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
 UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS sh FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.sh = i.sh AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 75"""


@query
def op6_secret_scan(spark, sf_dir):
    """Base patterns and inferred formats."""
    return secrets.digest(secrets.spans(table(spark, sf_dir, "documents")))


@query
def op9_license_scan(spark, sf_dir):
    """Exact phrases and fuzzy short notices."""
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op3_language_id(spark, sf_dir):
    """Learned from two thirds of the labelled documents."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 3)
    found = langid.predict(docs, langid.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op10_language_model(spark, sf_dir):
    """Learned from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 5))
    return lm.score(docs, docs.where(~F.col("held_out")))


@query
def op7_quality_classifier(spark, sf_dir):
    """A document's host is its source, its path there the language."""
    docs = table(spark, sf_dir, "documents").withColumns({"host": F.col("source"), "path": F.col("lang")})
    return quality.assess(docs, table(spark, sf_dir, "labels"))


@query
def op1_vector_near_dedup(spark, sf_dir):
    """Vectors of equal label with a cosine of 0.98 or more."""
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings"))


# every pair of a label in double precision, and labels spread over links until they settle
ORACLES["op1_vector_near_dedup"] = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
w AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, id = c AS kept FROM m LEFT JOIN n ON a = id"""


@query
def op2_warc_round_trip(spark, sf_dir):
    """Every page written to ZIP-packed archives and read back by byte range."""
    found = warc.read(warc.write(table(spark, sf_dir, "pages")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc_round_trip"] = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""


@query
def op11_quality_outliers(spark, sf_dir):
    """Fixed limits, and outliers per language and source."""
    return outliers.judge(table(spark, sf_dir, "documents"))


@query
def op12_conversation_repair(spark, sf_dir):
    """Conversations damaged by a checksum, and their cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(rows, repair.planted(rows)), with_turns=False).drop("turns")


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# damage in SQL; the cheapest edits turn by turn over the four states, with insertions between; then the edits replayed
ORACLES["op12_conversation_repair"] = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT conv_id, turn, role, text, {crc32_sql('name')} % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, {BLANKS}) AS said FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, left(role, 1) AS ini FROM o),
t AS MATERIALIZED (SELECT conv_id, turn, pos, role, text, ini, CASE WHEN said = '' THEN 'b' WHEN again THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS kind, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM s),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 'b') AS blank, count(*) FILTER (WHERE kind = 'd') AS duplicate, count(*) FILTER (WHERE kind = 't') AS truncated,
 count(*) FILTER (WHERE pos > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns FROM t GROUP BY conv_id),
mv(k, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
ed AS MATERIALIZED (SELECT ini, kind, p, q, c, a FROM (SELECT DISTINCT ini, kind FROM t), (SELECT DISTINCT p, p AS q, 3 AS c, 'D' AS a FROM ins)
 UNION ALL SELECT ini, kind, p, q, CASE kind WHEN 't' THEN 1 ELSE 0 END + CASE WHEN e = 'K' THEN 0 ELSE 2 END, e FROM (SELECT DISTINCT ini, kind FROM t WHERE kind NOT IN ('b', 'd')), mv, (VALUES ('K'), ('R')) v(e) WHERE CASE WHEN e = 'K' THEN k = ini ELSE k <> 's' END),
b(conv_id, pos, q, best) AS (SELECT conv_id, 0::BIGINT, q, {{'c': c, 'a': a}} FROM n, ins WHERE p = 0
 UNION ALL SELECT t.conv_id, t.pos, ins.q, min({{'c': best.c + ed.c + ins.c, 'a': best.a || ed.a || ins.a}}) FROM b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.pos = b.pos + 1 JOIN ed ON ed.ini = t.ini AND ed.kind = t.kind AND ed.p = b.q JOIN ins ON ins.p = ed.q GROUP BY ALL),
w AS MATERIALIZED (SELECT n.conv_id, min(best) AS best FROM b JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND pos = turns WHERE q IN (0, 3) GROUP BY ALL),
x AS (SELECT conv_id, best.a AS audit, length(regexp_replace(best.a, 'D', '', 'g')) % 2 AS odd, unnest(range(1, length(best.a) + 1)) AS i FROM w),
y AS (SELECT *, audit[i] AS e, length(regexp_replace(audit[:i], 'I', '', 'g')) AS pos, length(regexp_replace(audit[:i], 'D', '', 'g')) AS place FROM x),
z AS (SELECT y.conv_id, string_agg(CASE e WHEN 'K' THEN role ELSE CASE WHEN (place - 1 - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS body FROM y LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM y.conv_id AND t.pos = y.pos WHERE e <> 'D' GROUP BY y.conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM g.conv_id"""


@query
def op13_periodic_runs(spark, sf_dir):
    """Runs of whole texts, every tenth of which loops."""
    return runs.summary(runs.find(table(spark, sf_dir, "documents"), loops=True))


# stretches in which six words recur a period later, less those inside one of a smaller period
ORACLES["op13_periodic_runs"] = rf"""WITH k AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, doc_id::VARCHAR AS name FROM documents),
h AS (SELECT doc_id, ws, len(ws) AS n, {crc32_sql('name')} AS h FROM k), g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
l AS (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS ws FROM g),
w AS MATERIALIZED (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM l),
s AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i + 1:i + 6], ' ') AS six FROM (SELECT doc_id, ws, unnest(range(len(ws) - 5)) AS i FROM l)),
m AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.six = b.six AND b.i > a.i),
e AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
r AS MATERIALIZED (SELECT * FROM e WHERE NOT EXISTS (FROM e x WHERE x.doc_id = e.doc_id AND x.q < e.q AND x.start <= e.start AND x.start + x.length >= e.start + e.length)),
t AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'q': q}}, (-length, start, q)) AS top, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM w WHERE NOT EXISTS (FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256 FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""
