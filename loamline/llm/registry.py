"""The corpus operators as queries over the tables of one folder, and the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, chunk_dedup, exact_dedup, manifest, minhash, mixing, mpegts, orchard, packing, quality, site_style, toxicity, warc
from .common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op3_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return mixing.mix_sources(docs, weigh=quality.weigher(model) if model else mixing.plain_share).select("doc_id", "size", "source_size", "target", "taken")


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mpegts.demux_streams(written(mpegts.mux_documents(_table(spark, sf_dir, "documents")), "media"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points")


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(_table(spark, sf_dir, "pages"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op11_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chats(_table(spark, sf_dir, "conversations"))


def op12_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=16, rounds=3, seed=1, dim=64, scale=64)


def op13_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.documents_manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bradley_terry, op2_exact_dedup, op3_pattern_grammar, op4_mix_sources, op5_pattern_packing, op6_transport_streams, op7_warc_segments, op8_site_style_tree, op9_chosen_path, op10_chunk_dedup, op11_chat_segments, op12_orchard, op13_butterfly_manifest)}


_OP2 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


_OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
q AS (SELECT *, array_to_string(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> s) & 31) + 1 AS BIGINT), 1)).list_aggregate('string_agg', '')), '') AS payload_digest FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM q
"""

_OP9 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, coalesce(c.root, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON c.node = s.doc_id
"""


_OP11 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(\\|\[/?(?:SYS|INST|ROLE)\]|\[TEXT\]|</?s>)', '\\\1', 'g')) AS n, length(regexp_replace(role, '(\\|\[/?(?:SYS|INST|ROLE)\]|\[TEXT\]|</?s>)', '\\\1', 'g')) AS r,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS ends FROM t),
f AS (SELECT *, n + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 19 + r END AS chars,
  coalesce((before IS NULL AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant'), false) AS fits FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (NOT fits) AS bad_turns,
  bool_and(fits) AND bool_or(ends AND role IN ('user', 'assistant')) AS valid FROM f GROUP BY conv_id
"""


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds written out one after the other."""
    near = "SELECT a.id, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.id, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - m.v[i]) * (v.v[i] - m.v[i]))) AS d FROM v, m{0} m) a GROUP BY a.id"
    sql = f"""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || id)) - 1 AS c, v FROM v QUALIFY c < {k})"""
    for r in range(rounds):
        sql += f""",
a{r} AS ({near.format(r)}),
s{r} AS (SELECT c, i, sum(v.v[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (id), range(1, 65) AS t(i) GROUP BY c, i),
u{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c),
m{r + 1} AS (SELECT c, coalesce(u.v, m.v) AS v FROM m{r} m LEFT JOIN u{r} u USING (c))"""
    return sql + f""",
a AS ({near.format(rounds)})
SELECT id AS vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a JOIN m{rounds} m ON a.c = m.c"""


_OP13 = """
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a, n_chars,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS z, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT for x in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {crc}) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(a || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || z) AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(a || octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1) || z) END AS bad FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
n(lang, lvl, i, h, c) AS (SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM p
  UNION ALL SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((c + 1) // 2) FROM n WHERE c > 1 GROUP BY lang, lvl, i // 2),
r AS (SELECT lang, lvl AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM n WHERE c = 1),
t(lvl, i, h, c) AS (SELECT 0, g, subroot, (SELECT count(*) FROM r) FROM r
  UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((c + 1) // 2) FROM t WHERE c > 1 GROUP BY lvl, i // 2),
q AS (SELECT p.doc_id, p.lang, p.leaf, p.bad, p.i, r.top, r.subroot, r.g, (SELECT max(lvl) FROM t) AS high, (SELECT h FROM t WHERE c = 1) AS root FROM p JOIN r ON p.lang IS NOT DISTINCT FROM r.lang),
s AS (SELECT q.lang, q.i, n.lvl, n.h, n.i > (q.i >> n.lvl) AS after FROM q JOIN n ON n.lang IS NOT DISTINCT FROM q.lang AND n.lvl < q.top AND n.i = xor(q.i >> n.lvl, 1)
  UNION ALL SELECT q.lang, q.i, q.top + t.lvl, t.h, t.i > (q.g >> t.lvl) FROM q JOIN t ON t.lvl < q.high AND t.i = xor(q.g >> t.lvl, 1)),
w AS (SELECT lang, i, sha256(string_agg(h, '' ORDER BY lvl)) AS proof FROM s GROUP BY lang, i),
f(lang, i, lvl, ends, x) AS (SELECT lang, i, 0, top + high, coalesce(bad, leaf) FROM q
  UNION ALL SELECT f.lang, f.i, f.lvl + 1, f.ends, sha256(CASE WHEN s.after THEN f.x || s.h ELSE coalesce(s.h, '') || f.x END) FROM f LEFT JOIN s ON s.lang IS NOT DISTINCT FROM f.lang AND s.i = f.i AND s.lvl = f.lvl WHERE f.lvl < f.ends)
SELECT q.doc_id, q.leaf, q.subroot, q.root, coalesce(w.proof, sha256('')) AS proof_sha256, f.x AS folded_root, f.x = q.root AS verified
FROM q JOIN f ON f.lang IS NOT DISTINCT FROM q.lang AND f.i = q.i AND f.lvl = f.ends LEFT JOIN w ON w.lang IS NOT DISTINCT FROM q.lang AND w.i = q.i
"""


def _op13_sql() -> str:
    """The byte step of crc32 is written out bit by bit: DuckDB has no function for it."""
    crc = "xor(c, b)"
    for _ in range(8):
        crc = f"list_transform([{crc}], lambda y: xor(y >> 1, (y & 1) * 3988292384))[1]"
    return _OP13.replace("{crc}", crc)


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op7_warc_segments": _OP7, "op9_chosen_path": _OP9, "op11_chat_segments": _OP11, "op12_orchard": _op12_sql(), "op13_butterfly_manifest": _op13_sql()}
