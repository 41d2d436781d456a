"""The registered queries of the numbered operators: each applies its operator to its whole table."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm import chat, decontam, negatives, packing, quality, repair, secrets, shards, simhash, tokenfile, toxicity, urlrules, warc
from chronofact.llm.text import named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontam.SLOP)
    near = F.size("near_items").cast("long").alias("n_near"), F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *near)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(named(table(spark, sf_dir, "pages"), "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = named(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns.unionByName(extra))
    return chat.read_back(formatted, chat.examples(formatted))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(named(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = named(table(spark, sf_dir, "documents"), "doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = named(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_simhash_near_dedup, op2_token_binary, op3_decontamination, op4_warc, op5_url_filters, op6_best_fit_packing,
        op7_chat_formatting, op8_toxicity, op9_secret_scans, op10_quality_rules, op11_hard_negatives, op12_conversation_repair, op13_sharding,
    ]
    return {f.__name__: f for f in found}


UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

OP3 = f"""
WITH dl AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
il AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
ii AS (SELECT item_id, w, least(13, len(w)) AS n FROM il WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM ii),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM ii)),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dl, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dg JOIN iw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY 1),
dw AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM dl),
df AS (SELECT term, count(*) AS df FROM dw GROUP BY 1),
own AS (SELECT item_id, n, len(w) AS total, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM ii),
ow AS (SELECT item_id, n, total, pos AS a, list_sort(list(CASE WHEN df IS NOT NULL THEN {{'df': df, 'pos': pos}} END) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), 'ASC', 'NULLS LAST') AS r
FROM own LEFT JOIN df USING (term)),
win AS (SELECT item_id, n, a, r[1].pos AS p1, r[2].pos AS p2 FROM ow WHERE a + n <= total AND r[1] IS NOT NULL),
pl AS (SELECT DISTINCT item_id, p, term FROM (SELECT item_id, p1 AS p FROM win UNION ALL SELECT item_id, p2 FROM win) q JOIN own USING (item_id) WHERE q.p = own.pos),
sh AS (SELECT doc_id, item_id, pos - p AS s, p FROM dw JOIN pl USING (term)),
wn AS (SELECT win.item_id, n, a, p1, p2, count(*) AS k FROM win JOIN pl ON win.item_id = pl.item_id AND pl.p >= a AND pl.p < a + n WHERE p2 IS NOT NULL OR n = 1 GROUP BY ALL),
nr AS (SELECT x.doc_id, wn.item_id FROM wn JOIN sh x ON x.item_id = wn.item_id AND x.p = p1 JOIN sh y ON y.doc_id = x.doc_id AND y.item_id = x.item_id AND abs(y.s - x.s) <= 8 AND y.p >= a AND y.p < a + n
GROUP BY x.doc_id, wn.item_id, a, x.s, p2, k HAVING 5 * count(DISTINCT y.p) >= 4 * k AND (p2 IS NULL OR bool_or(y.p = p2))),
ne AS (SELECT doc_id, count(DISTINCT item_id) AS n_near, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS near_ids FROM nr GROUP BY 1)
SELECT doc_id, coalesce(n_near, 0) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dl LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN ne USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(h) >= 100 AND page_id <> first THEN first END AS refers_to,
array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), '.')), ',') || ')' || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1) AS url_key,
strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS timestamp FROM p
"""


def _prefixes_sql() -> str:
    """The longest fitting prefix rule as a CASE over the rules, longest first."""
    cases = []
    for rule, verdict in sorted(urlrules.PREFIXES, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{rest}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")
    return "CASE " + " ".join(cases) + " END"


def _line_sql(line: str) -> tuple[str, str] | None:
    """Verdict and condition on host || path of a line of the production list; None for lines that are no rules."""
    if line.startswith("!") or "##" in line or line.endswith("$third-party"):
        return None
    verdict, line = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    line = re.sub(r"^0\.0\.0\.0 (.*)", r"||\1^", line.removesuffix("$document"))
    if line[0] == line[-1] == "/" and len(line) > 2:
        return verdict, f"regexp_matches(host || path, '(?si){line[1:-1]}')"
    parts = {"*": ".*", "^": r"([\x00-$&-,/:-@\[-\^`\{-\x7F]|\z)"}
    start = r"^([^/]*\.)?" if line.startswith("||") else "^" if line.startswith("|") else ""
    body = "".join(parts.get(c) or re.escape(c) for c in line.strip("|"))
    return verdict, f"regexp_matches(host || path, '(?si){start}{body}{chr(92) + 'z' if line.endswith('|') else ''}')"


def _lists_sql(verdict: str) -> str:
    lines = [form.format(name) for name in urlrules.NAMES for form in urlrules.FORMS] + urlrules.LINES
    own = [f"regexp_matches(host || path, '{expression}')" for _, v, expression, _ in urlrules.PATTERNS if v == verdict]
    return " OR ".join(own + [r[1] for r in map(_line_sql, lines) if r and r[0] == verdict])


OP5 = (
    "WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "') AS host, "
    "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages), r AS (SELECT *, " + _prefixes_sql() + " AS best FROM p) "
    f"SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN {_lists_sql('allow')} THEN 'allow' WHEN {_lists_sql('block')} THEN 'block' ELSE 'allow' END) AS verdict FROM r"
)

OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')) + CASE WHEN role = 'assistant' THEN 9 ELSE 19 + length(role) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
count(*) FILTER (role = 'assistant') AS n_examples FROM s GROUP BY conv_id
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can state a result; the other operators are tested against brute force."""
    return {"op3_decontamination": OP3, "op4_warc": OP4, "op5_url_filters": OP5, "op7_chat_formatting": OP7, "op11_hard_negatives": OP11}
