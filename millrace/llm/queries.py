"""The registered queries of the operators, each over its whole table with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, wherever the installed package has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotrain import score_quality

    out = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_text", "p_meta", "p_quality", "keep")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).drop("matches")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import audio_features, store_media, with_digests

    out = with_digests(audio_features(store_media(_table(spark, sf_dir, "documents"))))
    loudest = F.coalesce(F.array_max(F.transform("segments", lambda s: s["energy"])), F.lit(-100.0))
    feature = F.format_string("frames=%d segments=%d loudest=%.3f mel=%08x", "frames", F.size("segments"), loudest, "mel_crc32")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    out = periodic_runs(_table(spark, sf_dir, "documents"), damaged=True)
    digest = F.sha2("text", 256).alias("collapsed_sha256")
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", digest, "n_words", "n_dropped")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import audit, damaged

    return audit(damaged(_table(spark, sf_dir, "conversations")))


def op13_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_lines": op7_lines,
    "op8_licenses": op8_licenses,
    "op9_substrings": op9_substrings,
    "op10_audio": op10_audio,
    "op11_periodic": op11_periodic,
    "op12_conversations": op12_conversations,
    "op13_htmltext": op13_htmltext,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: CRC-32 of an ASCII string s, bit by bit.
_CRC32 = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(unicode(s[i]) AS BIGINT) for i in range(1, length(s) + 1)],
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""


def _edit(w: str, cost: str, label: str, line: str | None) -> str:
    """The weight w (c: cost, l: labels, t: rows that are left) after an edit before it, which writes `line`."""
    rows = f"{w}.t" if line is None else f"{line} || CASE WHEN {w}.t = '' THEN '' ELSE chr(10) || {w}.t END"
    return f"CASE WHEN {w} IS NOT NULL THEN {{'c': {w}.c + {cost}, 'l': '{label}' || {w}.l, 't': {rows}}} END"


def _least(*weights: str) -> str:
    return f"list_min([w for w in [{', '.join(weights)}] if w IS NOT NULL])"


def _before_row(state: int) -> str:
    """The least weight from a state of the roles' grammar on, for the next row of x, of the weights w0 to w3 after it."""
    role, to = ("assistant", 3) if state == 2 else ("user", 2)
    keeps = f"CASE WHEN doomed THEN NULL WHEN initial = '{role[0]}' THEN {_edit(f'w{to}', 'cut', 'K', "role || ':' || text")}"
    if state == 0:
        keeps += f" WHEN initial = 's' THEN {_edit('w1', 'cut', 'K', "role || ':' || text")}"
    reroles = f"CASE WHEN NOT doomed THEN {_edit(f'w{to}', '1 + cut', 'R', f"'{role}:' || text")} END"
    return _least(_edit(f"w{state}", "2", "D", None), f"{keeps} END", reroles)


def _inserted(state: int, then: str) -> str:
    return _edit(then, "5", "I", "'assistant:'" if state == 2 else "'user:'")


_CONVERSATIONS = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32} % 20 AS f
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations)),
d AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, (SELECT unnest([1, 2]) AS copy) WHERE f <> 0 AND (copy = 1 OR f = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
p AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS two FROM o),
x AS (SELECT *, last = '' OR nth > 1 AS doomed, CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 5 END AS cut FROM p),
n AS (
  SELECT conv_id, count(*) AS n_turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (last = '') AS blank,
    count(*) FILTER (last <> '' AND nth > 1) AS duplicate, count(*) FILTER (NOT doomed AND cut > 0) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM x GROUP BY conv_id),
e AS (SELECT {{'c': 0, 'l': '', 't': ''}} AS w),
r(conv_id, i, w0, w1, w2, w3) AS (
  SELECT conv_id, n_turns + 1, w, {{'c': 10, 'l': 'II', 't': 'user:' || chr(10) || 'assistant:'}}, {{'c': 5, 'l': 'I', 't': 'assistant:'}}, w FROM n, e
  UNION ALL
  SELECT conv_id, i, {_least('w0', _inserted(0, 'e2'))}, {_least('w1', _inserted(1, 'e2'))}, {_least('w2', _inserted(2, 'e3'))}, {_least('w3', _inserted(3, 'e2'))}
  FROM (SELECT *, {_least('w2', _inserted(2, 'w3'))} AS e2, {_least('w3', _inserted(3, 'w2'))} AS e3 FROM (
    SELECT x.conv_id, x.i, {', '.join(f'{_before_row(g)} AS w{g}' for g in range(4))} FROM r JOIN x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.i = r.i - 1)))
SELECT a.conv_id, coalesce(n_turns, 0) AS n_turns, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(w0.c, 0) AS BIGINT) AS cost, coalesce(w0.l, '') AS audit, sha256(coalesce(w0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = 1"""

_HTML = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '\s+', ' ', 'g') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(replace(body, '<br>', ' '), '</?(p|h1)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS body FROM a),
c AS (
  SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))
    for x in string_split(body, chr(10))] AS blocks FROM b),
d AS (SELECT page_id, url, array_to_string([x for x in blocks if x <> ''], chr(10)) AS text FROM c)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM d"""

ORACLE_SQL: dict[str, str] = {
    "op12_conversations": _CONVERSATIONS,
    "op13_htmltext": _HTML,
    "op3_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
h AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM p LEFT JOIN h ON h.payload_digest = p.payload_digest""",
    "op6_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i+4], ' ') for i in range(1, len(words) - 3)]
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op7_lines": r"""
WITH w AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
v AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM w),
n AS (SELECT doc_id, i, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS n FROM v),
c AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n),
r AS (
  SELECT doc_id, i AS a, i + 2 AS b FROM v WHERE i + 2 <= len(lines) AND array_to_string(lines[i:i+2], '') <> ''
  UNION SELECT x.doc_id, x.i, min(y.i) FROM c x JOIN c y ON y.doc_id = x.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= 8 GROUP BY 1, 2
  UNION SELECT x.doc_id, max(x.i), y.i FROM c x JOIN c y ON y.doc_id = x.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= 8 GROUP BY 1, 3),
k AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY lines[a:b] ORDER BY doc_id, a) AS nth FROM r JOIN w USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM k WHERE nth > 1),
gone AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
t AS (SELECT doc_id, text, lines, coalesce(gone, []) AS gone FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(CASE WHEN len(gone) = 0 THEN text ELSE array_to_string([lines[i] for i in range(1, len(lines) + 1) if NOT list_contains(gone, i)], chr(10)) END) AS kept_sha256
FROM t""",
    "op9_substrings": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i+19], ' ')) AS h FROM v),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE nth > 1),
gone AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
t AS (SELECT doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string([words[i] for i in range(1, len(words) + 1) if NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM t""",
}
