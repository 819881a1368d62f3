"""The registered corpus queries, `(spark, sf_dir) -> DataFrame`, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import (
    conversation_repair, cross_polytope, decontaminate, hmm_score, html_extract, license_scan, line_dedup, mixing, near_dedup, quality_rules, source_audit,
    token_counts, url_filters,
)
from tessella.llm.common import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(quality_rules.stored(table(spark, sf_dir, "documents")))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and rejects alone, from one stored ledger."""
    entries = quality_rules.stored(table(spark, sf_dir, "documents"))
    parts = [quality_rules.ablation(entries, p).select(F.lit(p).alias("policy"), "rule", "n_failed", "n_only") for p in quality_rules.POLICIES]
    return parts[0].union(parts[1]).union(parts[2])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_score.score(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.with_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.audit_all(conversations, conversation_repair.damaged(conversations))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_html_extraction": op10_html_extraction,
    "op11_source_audit": op11_source_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_nearest_neighbours": op13_nearest_neighbours,
    "quality_ablation": quality_ablation,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Measures of the quality ledger. Windows are compared as text.
_OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS w
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
         coalesce(list_sum(list_transform(ws, lambda w, i: (i < len(ws) AND w = ws[i + 1])::INT)), 0)::BIGINT AS n_stutter
  FROM d LEFT JOIN cov USING (r)),
b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
            + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
            + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
            + 64 * (2 * n_upper > n_upper + n_lower)::BIGINT + 128 * (100 * n_stutter > 30 * n_words)::BIGINT AS failed_bits
  FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""

#: Bits of the ledger by policy: what each of its rules rejects, and what only it rejects.
_ABLATION = f"""
WITH l AS ({_OP2}),
p AS (SELECT * FROM (VALUES ('base', 3), ('v1', 15), ('v2', 255)) AS v(policy, mask)),
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32), ('shouting', 64), ('stutter', 128)) AS v(rule, bit))
SELECT policy, rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits & mask = bit) AS n_only
FROM l, p, r WHERE mask & bit <> 0 GROUP BY policy, rule
"""

#: Exact containment of every item in every document, by shingle text (no item has fewer than five words here). Rows equal in id
#: and text are one document.
_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM (SELECT DISTINCT doc_id, text FROM documents)),
i AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
g AS (
  SELECT DISTINCT r, doc_id, array_to_string(ws[i:i + 4], ' ') AS w
  FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM d)),
q AS (
  SELECT DISTINCT q, item_id, array_to_string(ws[i:i + 4], ' ') AS w
  FROM (SELECT q, item_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM i)),
n AS (SELECT q, count(*) AS n_shingles FROM q GROUP BY q)
SELECT doc_id, item_id, count(*) AS n_found, n_shingles, count(*) / n_shingles AS containment
FROM g JOIN q USING (w) JOIN n USING (q) GROUP BY r, doc_id, q, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""

#: Exact distinct sites of every line that has a word; no site is a site of its own.
_OP5 = r"""
WITH l AS (
  SELECT r, doc_id, coalesce('=' || source, '') AS site, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare,
         regexp_matches(line, '[^\x20\x09-\x0D]') AS long
  FROM (SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
b AS (SELECT bare, min(doc_id) AS keeper FROM l WHERE long GROUP BY bare HAVING count(DISTINCT site) >= 5),
m AS (SELECT l.*, coalesce(long AND doc_id <> keeper, false) AS gone FROM l LEFT JOIN b USING (bare))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
       count(*) FILTER (gone) AS n_removed
FROM m GROUP BY r, doc_id
"""

_OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k, md5(coalesce(text, '')) AS t FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER below, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS rest_w,
         row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS rn
  FROM s WINDOW below AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rest, rest_w FROM o WHERE rest * w < cap * rest_w ORDER BY rn LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN o.rest * w >= cap * o.rest_w OR f.rest IS NULL THEN cap::DOUBLE ELSE (f.rest * w)::DOUBLE / f.rest_w END AS target
  FROM o LEFT JOIN f ON true),
p AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM p
"""

#: The longest rule that fits, then the blocking patterns in their order, as regular expressions over host#path.
_OP8 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/]*(.*)$', 1, 's') AS path FROM p),
r AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM h),
b AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN host LIKE '%adult-%' THEN '*adult-*#*' WHEN host LIKE '%casino%' THEN '*casino*#*' WHEN host LIKE '%cheap-pills%' THEN '*cheap-pills*#*'
    WHEN host LIKE '%free-bets%' THEN '*free-bets*#*' WHEN host LIKE '%spam-farm%' THEN '*spam-farm*#*' WHEN host LIKE '%ads-track%' THEN '*ads-track*#*'
    WHEN host LIKE 'ads.%' THEN 'ads.*#*' WHEN host LIKE 'adserver.%' THEN 'adserver.*#*' WHEN host LIKE '%.doubleclick.%' THEN '*.doubleclick.*#*'
    WHEN path LIKE '%/wp-login.php' THEN '*#*/wp-login.php' WHEN path LIKE '%.exe' THEN '*#*.exe' END AS pattern FROM r)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') OR (rule IS NULL AND pattern IS NULL) THEN 'allow' ELSE 'block' END AS verdict
FROM b
"""

#: Shares of every kept term in every group, held pair by pair.
_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v))::BIGINT AS p
  FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)))::BIGINT AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term),
a AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
e AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM e QUALIFY part = 'pair' OR rank <= 10
"""


def _repair_sql() -> str:
    """The cheapest edits from the end of each conversation back: for each of nothing, system, user, assistant the least of (cost,
    letters, lines) that can follow. CRC-32 is computed from its table."""
    entry = lambda c, a, t: f"{{'c': {c}, 'a': {a}, 't': {t}}}"
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    put = lambda x, roles: entry(f"{x}.c + {5 * len(roles)}", f"'{'I' * len(roles)}' || {x}.a", " || ".join([*[f"chr(10) || '{r}:'" for r in roles], f"{x}.t"]))
    user, assistant = "d[3]", "d[4]"
    closed = "[" + ", ".join([
        least("d[1]", put(user, ["user"]), put(assistant, ["user", "assistant"])), least("d[2]", put(user, ["user"]), put(assistant, ["user", "assistant"])),
        least(user, put(assistant, ["assistant"])), least(assistant, put(user, ["user"])),
    ]) + "]"
    never, done = entry("1000000000::BIGINT", "''", "''"), entry("0::BIGINT", "''", "''")

    def edits(end: int) -> str:
        to = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}[end]
        anew, name = (4, "assistant") if end == 3 else (3, "user")
        out = [entry(f"e[{end}].c + 2", f"'D' || e[{end}].a", f"e[{end}].t")]
        for initial, then in to.items():
            out.append(f"CASE WHEN NOT gone AND x = '{initial}' THEN {entry(f'e[{then}].c + 5 * cut::INT', f"'K' || e[{then}].a", f"chr(10) || role || ':' || text || e[{then}].t")} ELSE {never} END")
        out.append(f"CASE WHEN NOT gone THEN {entry(f'e[{anew}].c + 1 + 5 * cut::INT', f"'R' || e[{anew}].a", f"chr(10) || '{name}:' || text || e[{anew}].t")} ELSE {never} END")
        return least(*out)

    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda y: ascii(y)::BIGINT) AS b
  FROM conversations),
f AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 20 AS fault FROM o, crc),
s AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS later,
         count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS x,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM s),
r AS (
  SELECT *, blank OR later AS gone, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x NOT IN ('su', 'ua', 'au') AS illegal FROM w),
z(conv_id, i, d) AS (
  SELECT DISTINCT conv_id, n + 1, [{done}, {never}, {never}, {done}] FROM r
  UNION ALL
  SELECT r.conv_id, r.i, [{edits(1)}, {edits(2)}, {edits(3)}, {edits(4)}]
  FROM (SELECT conv_id, i, {closed} AS e FROM z) y JOIN r ON r.conv_id IS NOT DISTINCT FROM y.conv_id AND r.i = y.i - 1),
b AS (SELECT conv_id, ({closed})[1] AS e FROM z WHERE i = 1),
m AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (later AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
       sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": _OP1,
    "op2_quality_rules": _OP2,
    "op5_line_dedup": _OP5,
    "op8_url_filters": _OP8,
    "op9_mixing": _OP9,
    "op11_source_audit": _OP11,
    "op12_conversation_repair": _repair_sql(),
    "quality_ablation": _ABLATION,
}
