"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

import re

from .quality_rules import REPEAT_WINDOW, RULES, STOP_WORDS, Rule
from .secret_scan import ALLOWED, ALLOWED_INSIDE, CLASSES

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _passes(r: Rule) -> list[str]:
    scale = f"CAST({r.denominator} AS DOUBLE)" if r.denominator else "1.0"
    out = [f"{r.numerator} >= {scale} * {r.low}"] if r.low is not None else []
    return out + ([f"{r.numerator} <= {scale} * {r.high}"] if r.high is not None else [])


def quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    w = REPEAT_WINDOW
    verdict = " AND ".join(c for r in RULES for c in _passes(r))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, {_WORDS.format("text")} AS words,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT doc_id, i, words[i:i + {w - 1}] AS key FROM s, unnest(range(1, len(words) - {w - 2})) AS u(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, unnest(range(0, {w})) AS u(j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
 CAST(length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
 len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
 len(regexp_extract_all(text, '\p{{Lu}}{{2,}}[^\x20\x09-\x0D]*')) AS n_shout_words,
 len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet_lines,
 len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) AS n_ellipsis_lines
 FROM s LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)"""


#: Smallest reachable id over links (a, b), in both directions.
_COMPONENTS = """links AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(node, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
parts AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""


def embedding_near_dedup(cosine: float = 0.98) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
 WHERE list_cosine_similarity(x.e, y.e) >= {cosine}),
{_COMPONENTS},
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id,
 coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN parts ON vec_id = node"""


def minhash_near_dedup(shingle: int = 4, percent: int = 80) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(lower)} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, words[i:i + {shingle - 1}] AS s FROM w, unnest(range(1, greatest(len(words) - {shingle - 2}, 2))) AS u(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
 WHERE 100 * c >= {percent} * (p.n_shingles + q.n_shingles - c)),
{_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n_shingles, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
 coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN parts ON d.doc_id = node"""


def substring_dedup(window: int = 35) -> str:
    return f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
k AS (SELECT doc_id, i, words[i:i + {window - 1}] AS key FROM w, unnest(range(1, len(words) - {window - 2})) AS u(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY key) AS n FROM k),
g AS (SELECT doc_id, p FROM r, unnest(range(0, {window})) AS u(j), LATERAL (SELECT i + j AS p) WHERE n > 1 GROUP BY ALL),
e AS (SELECT w.doc_id, u.p, words[u.p] AS word FROM w, unnest(range(1, len(words) + 1)) AS u(p)),
f AS (SELECT e.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY e.p) AS text FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(f.text, '')) AS kept_sha256 FROM w LEFT JOIN f USING (doc_id)"""


def chat_format() -> str:
    code = r"replace(replace(replace(replace({}, '\', '\b'), '### ', '\h'), '</part>', '\p'), '</turn>', '\t')"
    return rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM unnest([0, 1]) AS u(i)),
o AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, CASE WHEN before = role THEN 7 ELSE 6 + length(replace({code.format("role")}, chr(10), '\n')) END
 + length({code.format("text")}) + CASE WHEN after = role THEN 0 ELSE 8 END AS size FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(size) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id"""


def _either_case(words: str) -> str:
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


def secret_scan() -> str:
    """Positions are running sums over matches and the gaps between them; windows are cut out one by one."""
    assign = _either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    alphabet = "".join(dict.fromkeys(CLASSES[0].alphabet + CLASSES[1].alphabet))
    run = "[A-Za-z0-9+/_=-]{20,}"
    again = lambda times: "|".join(f"[{c}]{{{times}}}" if c != "-" else f"-{{{times}}}" for c in alphabet)
    allowed, inside = ALLOWED, [again("6") if r"\1" in a else a for a in ALLOWED_INSIDE]
    cut = f"{again('6,')}|=|//|(/[A-Za-z_-]+){{3,64}}"
    sql = lambda regex: "'" + regex.replace("'", "''") + "'"
    found = lambda value, patterns: "(" + " OR ".join(f"regexp_matches({value}, {sql(a)})" for a in patterns) + ")"
    kinds = [("assign", assign, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16), ("entropy", run, 0, 20)]
    matches = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS rank, {least} AS least, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap FROM (
 SELECT doc_id, regexp_extract_all(t, {sql(p)}) AS ms, regexp_extract_all(t, {sql(p)}, {group}) AS vs, string_split_regex(t, {sql(p)}) AS gaps FROM d)"""
        for k, (_, p, group, least) in enumerate(kinds)
    )
    bits = f"CASE WHEN regexp_full_match(v, {sql(CLASSES[0].shape)}) THEN {CLASSES[0].bits} ELSE {CLASSES[1].bits} END"
    w = CLASSES[0].window
    random = f"length(v) >= {w} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({matches}),
s AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM m),
p AS (SELECT doc_id, rank, stop - length(m) AS start, stop, v FROM s WHERE length(v) >= least),
c AS (SELECT *, {found("v", inside)} AS mixed FROM p WHERE rank = 3 AND {random} AND NOT {found("v", allowed)}),
e AS (SELECT doc_id, start, stop, v FROM c WHERE NOT mixed UNION ALL SELECT * FROM (SELECT doc_id, start, stop, unnest(string_split_regex(v, {sql(cut)})) AS v FROM c WHERE mixed)
 WHERE {random} AND NOT {found("v", [*allowed, *inside])}),
h AS (SELECT DISTINCT doc_id, start, stop FROM e
 WHERE list_max(list_transform(range(1, length(v) - {w - 2}), lambda i: list_aggregate(string_split(v[i:i + {w - 1}], ''), 'entropy'))) >= {bits}),
b AS (SELECT doc_id, rank, start, stop FROM p WHERE rank < 3),
spans AS (SELECT * FROM b UNION ALL SELECT doc_id, 3, start, stop FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = h.doc_id AND b.start <= h.start AND h.stop <= b.stop)),
o AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][rank + 1] || ':' || start || ':' || stop AS span FROM spans)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
 sha256(coalesce(string_agg(span, ',' ORDER BY start, rank, stop) FILTER (rank < 3), '')) AS base_sha256,
 coalesce(string_agg(span, ',' ORDER BY start, rank, stop), '') AS spans, count(*) FILTER (rank = 3) AS n_entropy
FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id"""
