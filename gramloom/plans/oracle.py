"""The catalog's queries in SQL, as other engines run them: shared parts, and the longer queries."""

from __future__ import annotations

from gramloom.functions.text import SEVERAL, transliteration


def ascii_(x: str) -> str:
    for c, more in SEVERAL.items():
        x = f"replace({x}, '{c}', '{more}')"
    pairs = [(a, b) for a, b in zip(*transliteration(), strict=True) if ord(a) < 0x180]
    old, new = ("".join(p).replace("'", "''") for p in zip(*pairs, strict=True))
    return f"translate({x}, '{old}', '{new}')"


PIECES = r"'[a-z0-9]+|[!-/:-@\[-`{-~]'"


def tokens(t: str) -> str:
    return f"CASE WHEN {t} IN ('_START_', '_END_') THEN [{t}] ELSE regexp_extract_all(regexp_replace(lower({ascii_(t)}), '[^!-~]', '', 'g'), {PIECES}) END"


def windows(n: int) -> str:
    return f"unnest(list_transform(range(1, len(tokens) - {n} + 2), lambda i: tokens[i:i + {n} - 1]))"


def prefix(t: str, n: int) -> str:
    special = rf"({t} IN ('_START_', '_END_') OR regexp_matches({t}, '^[!-/:-@\[-`{{-~]'))"
    short = "true" if n == 1 else f"regexp_matches({t}, '^[0-9]')"
    return f"CASE WHEN {special} THEN 'other' WHEN {short} THEN {t}[1] WHEN NOT regexp_matches({t}, '^.[a-z]') THEN {t}[1] || '_' ELSE {t}[1:2] END"


TAGGED = "CASE WHEN w IN ('_START_', '_END_') THEN w ELSE w || ['', '_NOUN', '_X', '_VERB_'][length(w) % 4 + 1] END"
IS_TAGGED = r"regexp_matches(w, '_(NOUN|VERB|ADJ|ADV|PRON|DET|ADP|NUM|CONJ|PRT|\.|X)_?$')"


def part(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^[0-9a-z]') THEN {t}[1] ELSE '_' END"


PART = part("token")


def _corpus(source: str = "documents", id_col: str = "doc_id", raw: str = "raw", name: str = "sentences", normal: bool = True, keyed: bool = False) -> str:
    """keyed: each token behind the letter of its partition, so that strings have the order of the vocabulary."""
    marked = "text"
    for m in ("START", "END"):
        marked = rf"regexp_replace({marked}, '(^|[\s\pZ])_{m}_($|[\s\pZ])', '\1_ {m} _\2', 'g')"
    out = rf"""
    {raw} AS MATERIALIZED (
        SELECT {id_col}, sent, ['_START_'] || list_filter(string_split_regex(s, '[\s\pZ]+'), lambda w: w <> '') || ['_END_'] AS tokens FROM (
            SELECT {id_col}, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sent FROM (
                SELECT {id_col}, list_filter(string_split_regex(regexp_replace({marked}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '[\s\pZ]{{2,}}'), lambda x: x <> '') AS ss
                FROM (SELECT {id_col}, replace(text, chr(10), '  ') AS text FROM {source}))))"""
    if normal:
        own = f"flatten(list_transform(tokens, lambda t: {tokens('t')}))"
        own = f"list_transform({own}, lambda t: {part('t')} || t)" if keyed else own
        out += f""",
    {name} AS MATERIALIZED (SELECT {id_col}, sent, {own} AS tokens FROM {raw})"""
    return out


def with_raw(sql: str) -> str:
    return f"WITH {_corpus(normal=False)} {sql}"


def with_sentences(sql: str) -> str:
    return f"WITH {_corpus()} {sql}"


_IDS = {"conversations": "conv_id", "benchmark": "item_id"}


def _asked(source: str, keyed: bool = False) -> str:
    return _corpus(source, _IDS[source], "raw_asked", "asked", keyed=keyed)


def _marks(sql: str) -> str:
    """The sentence marks as keyed tokens."""
    return sql.replace("'_START_'", "'__START_'").replace("'_END_'", "'__END_'")


def with_asked(sql: str, source: str) -> str:
    return f"WITH {_corpus()}, {_asked(source)} {sql}"


_VOCAB = f"""
    vocab AS (SELECT row_number() OVER (ORDER BY instr('0123456789_abcdefghijklmnopqrstuvwxyz', part), token) AS token_id, token, part
              FROM (SELECT token, {PART} AS part FROM (SELECT DISTINCT unnest(tokens) AS token FROM sentences)))"""


def with_vocab(sql: str, asked: str | None = None) -> str:
    return f"WITH {_corpus()}, {_VOCAB} {', ' + _asked(asked) if asked else ''} {sql}"


def _counted(n: int) -> str:
    return f"t{n} AS MATERIALIZED (SELECT {', '.join(f'g[{i}] AS w{i}' for i in range(1, n + 1))}, count(*) AS count FROM (SELECT {windows(n)} AS g FROM sentences) GROUP BY ALL)"


_COUNTS = ", ".join(map(_counted, (1, 2, 3)))
#: Consistent tables of orders 1 to 3, and 1 to 2.
_CONSISTENT = """
    k3 AS (SELECT * FROM t3),
    k2 AS MATERIALIZED (SELECT w1, w2, max(count)::BIGINT AS count FROM (
        SELECT * FROM t2 UNION ALL SELECT w1, w2, sum(count) FROM t3 GROUP BY 1, 2 UNION ALL SELECT w2, w3, sum(count) FROM t3 GROUP BY 1, 2) GROUP BY 1, 2),
    k1 AS MATERIALIZED (SELECT w1, max(count)::BIGINT AS count FROM (
        SELECT * FROM t1 UNION ALL SELECT w1, sum(count) FROM k2 GROUP BY 1 UNION ALL SELECT w2, sum(count) FROM k2 GROUP BY 1) GROUP BY 1)"""


def with_counts(sql: str) -> str:
    return f"WITH {_corpus()}, {_COUNTS} {sql}"


def with_consistent(sql: str) -> str:
    return f"WITH {_corpus()}, {_COUNTS}, {_CONSISTENT} {sql}"


_RANGES = """
    r1 AS MATERIALIZED (SELECT w1, (sum(count) OVER (ORDER BY w1) - count)::BIGINT AS cf1, (sum(count) OVER (ORDER BY w1))::BIGINT AS cf2
           FROM (SELECT a.token_id AS w1, count FROM t1 JOIN vocab a ON a.token = w1)),
    r2 AS MATERIALIZED (SELECT w1, w2, (sum(count) OVER (ORDER BY w1, w2) - count)::BIGINT AS cf1, (sum(count) OVER (ORDER BY w1, w2))::BIGINT AS cf2
           FROM (SELECT a.token_id AS w1, b.token_id AS w2, count FROM t2 JOIN vocab a ON a.token = w1 JOIN vocab b ON b.token = w2)),
    r3 AS MATERIALIZED (SELECT w1, w2, w3, (sum(count) OVER (ORDER BY w1, w2, w3) - count)::BIGINT AS cf1, (sum(count) OVER (ORDER BY w1, w2, w3))::BIGINT AS cf2
           FROM (SELECT a.token_id AS w1, b.token_id AS w2, c.token_id AS w3, count FROM t3 JOIN vocab a ON a.token = w1 JOIN vocab b ON b.token = w2 JOIN vocab c ON c.token = w3)),
    x3 AS (SELECT w1, w2, min(cf1) AS a, max(cf2) AS b FROM r3 GROUP BY 1, 2), x2 AS (SELECT w1, min(cf1) AS a, max(cf2) AS b FROM r2 GROUP BY 1), x1 AS (SELECT min(cf1) AS a, max(cf2) AS b FROM r1)"""


def with_ranges(sql: str, asked: str | None = None) -> str:
    return f"WITH {_corpus()}, {_VOCAB}, {_COUNTS}, {_RANGES} {', ' + _asked(asked) if asked else ''} {sql}"


PROBABILITIES = with_ranges(
    f""",
    q AS (SELECT DISTINCT {windows(3)} AS g FROM asked),
    i AS (SELECT g, a.token_id AS c1, b.token_id AS c2, c.token_id AS w FROM q LEFT JOIN vocab a ON a.token = g[1] LEFT JOIN vocab b ON b.token = g[2] LEFT JOIN vocab c ON c.token = g[3]),
    f AS (SELECT g, 3 AS level, r3.cf1 - x3.a AS lo, r3.cf2 - x3.a AS hi, x3.b - x3.a AS total FROM i JOIN r3 ON r3.w1 = c1 AND r3.w2 = c2 AND r3.w3 = w JOIN x3 ON x3.w1 = c1 AND x3.w2 = c2
          UNION ALL SELECT g, 2, r2.cf1 - x2.a, r2.cf2 - x2.a, x2.b - x2.a FROM i JOIN r2 ON r2.w1 = c2 AND r2.w2 = w JOIN x2 ON x2.w1 = c2
          UNION ALL SELECT g, 1, r1.cf1, r1.cf2, (SELECT max(cf2) FROM r1) FROM i JOIN r1 ON r1.w1 = w),
    top AS (SELECT g, max(level) AS level, arg_max(lo, level) AS lo, arg_max(hi, level) AS hi, arg_max(total, level) AS total FROM f GROUP BY g)
    SELECT array_to_string(q.g, ' ') AS ngram, coalesce(lo, -1)::BIGINT AS lo, coalesce(hi, -1)::BIGINT AS hi, coalesce(total, -1)::BIGINT AS total, coalesce(level, -1)::INT AS level FROM q LEFT JOIN top ON top.g = q.g
    """,
    "benchmark",
)

NEXT = with_ranges(
    f""",
    q AS (SELECT g, unnest([13, 500, 999]) AS num, unnest([1, 10, 1]) AS size FROM (SELECT DISTINCT {windows(2)} AS g FROM asked)),
    i AS (SELECT g, num, size, a.token_id AS c1, b.token_id AS c2 FROM q LEFT JOIN vocab a ON a.token = g[1] LEFT JOIN vocab b ON b.token = g[2]),
    l AS (SELECT g, num, size, c1, c2, CASE WHEN x3.a IS NOT NULL THEN 3 WHEN x2.a IS NOT NULL THEN 2 ELSE 1 END AS level, coalesce(x3.a, x2.a, x1.a) AS a, coalesce(x3.b - x3.a, x2.b - x2.a, x1.b - x1.a) AS s
          FROM i LEFT JOIN x3 ON x3.w1 = c1 AND x3.w2 = c2 LEFT JOIN x2 ON x2.w1 = c2 CROSS JOIN x1),
    e AS (SELECT *, a + (num * s) // 1000 AS lo, a + ((num + size) * s + 999) // 1000 AS hi FROM l),
    f AS (SELECT g, num, r3.w3 AS w FROM e JOIN r3 ON level = 3 AND r3.w1 = c1 AND r3.w2 = c2 AND cf1 <= lo AND cf2 >= hi
          UNION ALL SELECT g, num, r2.w2 FROM e JOIN r2 ON level = 2 AND r2.w1 = c2 AND cf1 <= lo AND cf2 >= hi
          UNION ALL SELECT g, num, r1.w1 FROM e JOIN r1 ON level = 1 AND cf1 <= lo AND cf2 >= hi)
    SELECT array_to_string(e.g, ' ') AS context, e.num::BIGINT AS num, level, coalesce(token, '') AS word FROM e LEFT JOIN f ON e.g = f.g AND e.num = f.num LEFT JOIN vocab ON token_id = w
    """,
    "benchmark",
)

EDGE = with_raw(f"""
    , g AS (SELECT g, count(*) AS n FROM (SELECT {windows(2)} AS g FROM raw UNION ALL SELECT {windows(3)} FROM raw) GROUP BY ALL),
    p AS (SELECT n, list_transform(g, lambda t: {tokens("t")}) AS p FROM g),
    m AS (SELECT n, p[1] AS l, flatten(p[2:len(p) - 1]) AS m, p[-1] AS r FROM p WHERE len(p[1]) > 0 AND len(p[-1]) > 0),
    e AS (SELECT n, l, m, r, unnest([1, 1, 2]) AS ls, unnest([1, 2, 1]) AS rs FROM m)
    SELECT array_to_string(l[len(l) - ls + 1:len(l)] || m || r[1:rs], ' ') AS ngram, sum(n)::BIGINT AS count FROM e WHERE ls <= len(l) AND rs <= len(r) AND ls + len(m) + rs <= 3 GROUP BY 1
    """)

SINGLE = with_raw(f"""
    , g AS (SELECT t, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM raw) GROUP BY ALL), p AS (SELECT n, {tokens("t")} AS p FROM g),
    s AS (SELECT n, p, unnest(range(1, len(p) + 1)) AS i FROM p), e AS (SELECT n, p, i, unnest([1, 2, 3]) AS k FROM s)
    SELECT array_to_string(p[i:i + k - 1], ' ') AS ngram, sum(n)::BIGINT AS count FROM e WHERE i + k - 1 <= len(p) GROUP BY 1
    """)

LETTERS = rf"""
    WITH w AS (SELECT unnest(string_split_regex(regexp_replace(lower({ascii_("regexp_replace(text, '\\n+$', '') || ' '")}), '[^a-z0-9!"''(),\-.:;?\s\pZ]', '', 'g'), '[\s\pZ]')[:-2]) AS x FROM documents),
    c AS (SELECT ' ' || x || ' ' AS x, count(*) AS k FROM w GROUP BY ALL),
    e AS (SELECT x, k, n, unnest(range(CASE WHEN n = 1 THEN 2 ELSE 1 END, length(x) - n + 2)) AS i FROM (SELECT x, k, unnest([1, 2, 3]) AS n FROM c))
    SELECT n, substr(x, i, n) AS gram, sum(k)::BIGINT AS count FROM e GROUP BY 1, 2
    """

_TAGGED = r"""
    g AS (SELECT role, unnest(list_transform(range(1, len(t)), lambda i: t[i:i + 1])) AS g FROM (SELECT role, list_filter(string_split_regex(text, '[\s\pZ]+'), lambda w: w <> '') AS t FROM conversations)),
    rows AS (SELECT role, CASE WHEN length(g[1]) = 1 THEN 'q!' ELSE g[1] END AS w1, CASE WHEN length(g[2]) = 1 THEN 'q!' ELSE g[2] END AS w2 FROM g),
    cnt AS (SELECT role, w1, w2, count(*) AS p FROM rows GROUP BY ALL),
    cum AS MATERIALIZED (SELECT * FROM (SELECT role, w1, w2, p, (sum(p) OVER o - p)::BIGINT AS c1, (sum(p) OVER o)::BIGINT AS c2 FROM cnt WINDOW o AS (ORDER BY role, w1, w2)) WHERE w1 <> 'q!' AND w2 <> 'q!'),
    low AS (SELECT c1 AS i, lower(w1) AS w1, lower(w2) AS w2, p, c1, c2 FROM cum),
    m AS (SELECT 2 AS n, w1, w2, sum(p)::BIGINT AS p, min(c1) AS c1, max(c2) AS c2, min(i) AS i FROM low GROUP BY w1, w2
          UNION ALL SELECT 1, w1, NULL, sum(p)::BIGINT, min(c1), max(c2), min(i) FROM low GROUP BY w1
          UNION ALL SELECT 0, NULL, NULL, sum(p)::BIGINT, min(c1), max(c2), min(i) FROM low),
    marg AS MATERIALIZED (SELECT n, row_number() OVER (PARTITION BY n ORDER BY i, w1, w2) AS i, w1, w2, p, c1, c2 FROM m)"""
_PAIRS = r"""pairs AS (SELECT DISTINCT g[1] AS c1, g[2] AS w FROM (
        SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i:i + 1])) AS g FROM (SELECT list_filter(string_split_regex(lower(text), '[\s\pZ]+'), lambda w: w <> '') AS t FROM benchmark)))"""


def with_tagged(sql: str) -> str:
    return f"WITH {_TAGGED} {sql}"


TAGGED_PROBABILITY = with_tagged(f""",
    {_PAIRS},
    f AS (SELECT q.c1, q.w, 2 AS level, g.p / x.p AS p, (g.c1 - x.c1) / x.p AS lo, (g.c2 - x.c1) / x.p AS hi FROM pairs q JOIN marg g ON g.n = 2 AND g.w1 = q.c1 AND g.w2 = q.w JOIN marg x ON x.n = 1 AND x.w1 = q.c1
          UNION ALL SELECT q.c1, q.w, 1, g.p / t.p, (g.c1 - t.c1) / t.p, (g.c2 - t.c1) / t.p FROM pairs q JOIN marg g ON g.n = 1 AND g.w1 = q.w CROSS JOIN (SELECT * FROM marg WHERE n = 0) t),
    top AS (SELECT c1, w, max(level) AS level, arg_max(p, level) AS p, arg_max(lo, level) AS lo, arg_max(hi, level) AS hi FROM f GROUP BY 1, 2)
    SELECT q.c1 || ' ' || q.w AS pair, round(coalesce(p, -1), 9) AS probability, round(coalesce(lo, -1), 9) AS lo, round(coalesce(hi, -1), 9) AS hi, coalesce(level, 0)::INT AS level FROM pairs q LEFT JOIN top USING (c1, w)
    """)

TAGGED_MATCH = with_tagged(f""",
    {_PAIRS},
    q AS (SELECT c1 AS c, unnest([7, 30, 90]) AS num, unnest([1, 40, 10]) AS size FROM (SELECT DISTINCT c1 FROM pairs)),
    e AS (SELECT c, num, greatest(x.c1 + (x.p * num) // 100, x.c1) AS a, least(x.c1 + (x.p * (num + size) + 99) // 100, x.c2) AS b FROM q JOIN marg x ON x.n = 1 AND x.w1 = c),
    k AS (SELECT c, num, w2, g.c1, CASE WHEN g.c1 <= a AND g.c2 >= b THEN 1 WHEN g.c1 >= a AND g.c2 <= b THEN 2 WHEN (g.c1 < a AND g.c2 > a) OR (g.c1 < b AND g.c2 > b) THEN 3 END AS kind,
                 CASE WHEN g.c1 < a AND g.c2 > a THEN g.c2 - a ELSE b - g.c1 END AS share FROM e JOIN marg g ON g.n = 2 AND g.w1 = c),
    r AS (SELECT *, row_number() OVER (PARTITION BY c, num ORDER BY kind, CASE WHEN kind = 3 THEN -share ELSE 0 END, c1, w2) AS o FROM k WHERE kind IS NOT NULL)
    SELECT q.c || ' ' || q.num AS id, coalesce(w2, '') AS word, coalesce(kind, 0) AS kind FROM q LEFT JOIN r ON r.c = q.c AND r.num = q.num AND o = 1
    """)

_TRIPLES = r"""
    words AS (SELECT role, list_filter(string_split_regex(text, '[\s\pZ]+'), lambda w: w <> '') AS t FROM conversations),
    grams AS (SELECT role, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2])) AS g FROM words),
    cnt AS (SELECT role, CASE WHEN length(g[1]) = 1 THEN 'q!' ELSE g[1] END AS w1, CASE WHEN length(g[2]) = 1 THEN 'q!' ELSE g[2] END AS w2, CASE WHEN length(g[3]) = 1 THEN 'q!' ELSE g[3] END AS w3, count(*) AS p FROM grams GROUP BY ALL),
    cum AS (SELECT * FROM (SELECT w1, w2, w3, p, (sum(p) OVER o - p)::BIGINT AS c1, (sum(p) OVER o)::BIGINT AS c2 FROM cnt WINDOW o AS (ORDER BY role, w1, w2, w3)) WHERE w1 <> 'q!' AND w2 <> 'q!' AND w3 <> 'q!'),
    low AS MATERIALIZED (SELECT lower(w1) AS w1, lower(w2) AS w2, lower(w3) AS w3, p, c1, c2 FROM cum),
    m AS MATERIALIZED (SELECT k, sum(p)::BIGINT AS p, min(c1) AS c1, max(c2) AS c2 FROM (SELECT unnest([[w1, w2, w3], [w1, w2], [w1], []::VARCHAR[]]) AS k, p, c1, c2 FROM low) GROUP BY k),
    tri AS MATERIALIZED (SELECT DISTINCT g FROM (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2])) AS g FROM (SELECT list_filter(string_split_regex(lower(text), '[\s\pZ]+'), lambda w: w <> '') AS t FROM benchmark)))"""

TAGGED_SEQUENCES = f"""WITH {_TRIPLES},
    q AS MATERIALIZED (SELECT DISTINCT g[1:k] AS c, g[k + 1:3] AS s FROM tri, range(3) AS r(k)),
    e AS (SELECT c, s, u, c[len(c) - u + 1:len(c)] AS x FROM q, range(3) AS r(u) WHERE u <= len(c)),
    f AS (SELECT e.c, e.s, u, g.p / h.p AS p, (g.c1 - h.c1) / h.p AS lo, (g.c2 - h.c1) / h.p AS hi FROM e JOIN m g ON g.k = list_concat(e.x, e.s) JOIN m h ON h.k = e.x),
    b AS (SELECT c, s, max(u) AS u, arg_max(p, u) AS p, arg_max(lo, u) AS lo, arg_max(hi, u) AS hi FROM f GROUP BY c, s)
    SELECT array_to_string(q.c, ' ') AS context, array_to_string(q.s, ' ') AS words, round(coalesce(p, -1), 9) AS probability, round(coalesce(lo, -1), 9) AS lo, round(coalesce(hi, -1), 9) AS hi, coalesce(u, -1)::INT AS used FROM q LEFT JOIN b ON b.c = q.c AND b.s = q.s"""

TAGGED_TRIPLES = f"""WITH {_TRIPLES},
    q AS MATERIALIZED (SELECT DISTINCT g[1:k] AS c FROM tri, range(3) AS r(k)),
    e AS (SELECT c, max(u) AS u, arg_max(m.k, u) AS x, arg_max(m.p, u) AS p, arg_max(m.c1, u) AS c1, arg_max(m.c2, u) AS c2 FROM (SELECT c, u, c[len(c) - u + 1:len(c)] AS x FROM q, range(3) AS r(u) WHERE u <= len(c)) AS s JOIN m ON m.k = s.x GROUP BY c),
    i AS (SELECT e.*, num, size FROM e, (VALUES (7, 1), (30, 40), (90, 10)) AS v(num, size)),
    a AS MATERIALIZED (SELECT x, num, any_value(greatest(c1 + (p * num) // 100, c1)) AS a, any_value(least(c1 + (p * (num + size) + 99) // 100, c2)) AS b FROM i GROUP BY x, num),
    w AS (SELECT k[1:len(k) - 1] AS x, k[len(k)] AS w, c1, c2 FROM m WHERE len(k) > 0),
    d AS (SELECT a.x, num, w, c1, c2, CASE WHEN c1 <= a AND c2 >= b THEN 1 WHEN c1 >= a AND c2 <= b THEN 2 WHEN (c1 < a AND c2 > a) OR (c1 < b AND c2 > b) THEN 3 END AS kind, CASE WHEN c1 < a AND c2 > a THEN c2 - a ELSE b - c1 END AS share FROM a JOIN w ON w.x = a.x),
    r AS (SELECT *, row_number() OVER (PARTITION BY x, num ORDER BY kind, CASE kind WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE -share END, c1) AS o FROM d WHERE kind IS NOT NULL)
    SELECT array_to_string(q.c, ' ') AS context, v.num::INT AS num, coalesce(r.w, '') AS word, coalesce(r.kind, 0)::INT AS kind, coalesce(e.u, -1)::INT AS used
    FROM q CROSS JOIN (VALUES (7), (30), (90)) AS v(num) LEFT JOIN e ON e.c = q.c LEFT JOIN r ON r.x = e.x AND r.num = v.num AND r.o = 1"""

#: Parameters of the back-off model.
BETA, GAMMA = 0.1, 0.01
_WEIGHT = f"ceil(CAST(acc AS DOUBLE) / CAST(acc AS DOUBLE) * ({BETA} * (tot - acc) + {GAMMA} * tot))"

DISTRIBUTION = f"WITH {_corpus(keyed=True)}, {_counted(1)}, {_counted(2)}," + _marks(f"""
    k1 AS (SELECT w1, max(count)::BIGINT AS count FROM (SELECT * FROM t1 UNION ALL SELECT w1, sum(count) FROM t2 GROUP BY 1 UNION ALL SELECT w2, sum(count) FROM t2 GROUP BY 1) GROUP BY 1),
    m AS (SELECT w1, w2, count, NOT (w2 = '_START_' OR (w1 = '_START_' AND w2 = '_END_')) AS ok FROM t2 WHERE w1 <> '_END_'),
    s AS (SELECT m.w1, sum(m.count) FILTER (ok) AS acc, any_value(k1.count) - coalesce(sum(m.count) FILTER (NOT ok), 0) AS tot FROM m JOIN k1 ON k1.w1 = m.w1 GROUP BY m.w1)
    SELECT w1[2:] AS context, w2[2:] AS token, (sum(count) OVER (PARTITION BY w1 ORDER BY w2) - count)::BIGINT AS cum, count AS len FROM m WHERE ok
    UNION ALL SELECT w1[2:], '', acc::BIGINT, {_WEIGHT}::BIGINT FROM s WHERE acc > 0
    """)

_SCORED = f"""
    each AS MATERIALIZED (SELECT item_id, sent, pos, CASE WHEN pos >= 3 THEN tokens[pos - 2] END AS c1, CASE WHEN pos >= 2 THEN tokens[pos - 1] END AS c2, tokens[pos] AS w
             FROM (SELECT item_id, sent, tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM asked)),
    q AS (SELECT DISTINCT c1, c2, w FROM each),
    b3 AS (SELECT w1, w2, sum(count) FILTER (ok) AS acc, coalesce(sum(count) FILTER (NOT ok), 0) AS rej FROM (SELECT *, NOT (w3 = '_START_' OR (w2 = '_START_' AND w3 = '_END_')) AS ok FROM k3) GROUP BY 1, 2),
    b2 AS (SELECT w1, sum(count) FILTER (ok) AS acc, coalesce(sum(count) FILTER (NOT ok), 0) AS rej FROM (SELECT *, NOT (w2 = '_START_' OR (w1 = '_START_' AND w2 = '_END_')) AS ok FROM k2) GROUP BY 1),
    b1 AS (SELECT sum(count) AS acc FROM k1 WHERE w1 <> '_START_'),
    n2 AS (SELECT k3.w1 AS b, k3.w2 AS w1, sum(k2.count) AS r FROM k3 JOIN k2 ON k2.w1 = k3.w2 AND k2.w2 = k3.w3 WHERE NOT (k3.w3 = '_START_' OR (k3.w2 = '_START_' AND k3.w3 = '_END_')) GROUP BY 1, 2),
    n1 AS (SELECT k2.w1 AS b, sum(k1.count) AS r FROM k2 JOIN k1 ON k1.w1 = k2.w2 WHERE NOT (k2.w2 = '_START_' OR (k2.w1 = '_START_' AND k2.w2 = '_END_')) GROUP BY 1),
    j AS (SELECT q.c1, q.c2, q.w, (q.w = '_START_' OR coalesce(q.c2 = '_START_' AND q.w = '_END_', false)) AS barred,
                 b3.acc AS acc3, x3.count - b3.rej AS tot3, g3.count AS g3,
                 b2.acc - coalesce(n2.r, 0) AS acc2, x2.count - b2.rej - coalesce(n2.r, 0) AS tot2, g2.count AS g2,
                 b1.acc - coalesce(n1.r, 0) - CASE WHEN q.c2 = '_START_' THEN (SELECT count FROM k1 WHERE w1 = '_END_') ELSE 0 END AS acc1, g1.count AS g1
          FROM q LEFT JOIN b3 ON b3.w1 = q.c1 AND b3.w2 = q.c2 LEFT JOIN k2 x3 ON x3.w1 = q.c1 AND x3.w2 = q.c2 LEFT JOIN k3 g3 ON g3.w1 = q.c1 AND g3.w2 = q.c2 AND g3.w3 = q.w
          LEFT JOIN b2 ON b2.w1 = q.c2 LEFT JOIN k1 x2 ON x2.w1 = q.c2 LEFT JOIN k2 g2 ON g2.w1 = q.c2 AND g2.w2 = q.w LEFT JOIN n2 ON n2.b = q.c1 AND n2.w1 = q.c2
          CROSS JOIN b1 LEFT JOIN k1 g1 ON g1.w1 = q.w LEFT JOIN n1 ON n1.b = q.c2),
    s1 AS (SELECT *, CASE WHEN g1 IS NOT NULL AND NOT barred AND acc1 > 0 THEN log2(acc1) - log2(g1) END AS bits1 FROM j),
    s2 AS (SELECT *, ceil({BETA} * (tot2 - acc2) + {GAMMA} * tot2) AS v2, ceil({BETA} * (tot3 - acc3) + {GAMMA} * tot3) AS v3 FROM s1),
    s3 AS (SELECT *, CASE WHEN g2 IS NOT NULL AND NOT barred THEN log2(acc2 + v2) - log2(g2) WHEN acc2 IS NULL OR acc2 <= 0 THEN bits1 ELSE bits1 + log2(acc2 + v2) - log2(v2) END AS bits2,
                  CASE WHEN g2 IS NOT NULL AND NOT barred THEN 2 WHEN bits1 IS NOT NULL THEN 1 END AS level2 FROM s2),
    s4 AS (SELECT *, CASE WHEN g3 IS NOT NULL AND NOT barred THEN log2(acc3 + v3) - log2(g3) WHEN acc3 IS NULL OR acc3 <= 0 THEN bits2 ELSE bits2 + log2(acc3 + v3) - log2(v3) END AS bits3,
                  CASE WHEN g3 IS NOT NULL AND NOT barred THEN 3 ELSE level2 END AS level3 FROM s3),
    score AS MATERIALIZED (SELECT c1, c2, w, CASE WHEN c2 IS NULL THEN CASE WHEN w = '_START_' THEN 0.0 END WHEN c1 IS NULL THEN bits2 ELSE bits3 END AS bits,
              CASE WHEN c2 IS NULL THEN CASE WHEN w = '_START_' THEN 1 END WHEN c1 IS NULL THEN level2 ELSE level3 END AS level FROM s4)"""

SCORES = f"WITH {_corpus()}, {_COUNTS}, {_CONSISTENT}, {_asked('benchmark')}, {_SCORED} SELECT concat_ws(' ', c1, c2, w) AS ngram, round(coalesce(bits, -1), 6) AS bits, coalesce(level, 0) AS level FROM score"

ENTROPY = f"""WITH {_corpus()}, {_COUNTS}, {_CONSISTENT}, {_asked("benchmark")}, {_SCORED}
    SELECT item_id, count(*) AS n_tokens, count(*) FILTER (bits IS NULL) AS n_impossible, round(coalesce(sum(bits), 0), 4) AS bits,
           round(sum(bits) FILTER (pos > 1) / count(bits) FILTER (pos > 1), 4) AS bits_per_word, round(sum(bits) FILTER (pos > 1) / sum(CASE WHEN bits IS NOT NULL THEN length(each.w) + 1 END) FILTER (pos > 1), 4) AS bits_per_character,
           round(pow(2.0, sum(bits) FILTER (pos > 1) / count(bits) FILTER (pos > 1)), 4) AS perplexity
    FROM each JOIN score ON each.c1 IS NOT DISTINCT FROM score.c1 AND each.c2 IS NOT DISTINCT FROM score.c2 AND each.w = score.w GROUP BY item_id
    """


def with_letters(sql: str) -> str:
    return f"WITH l AS (SELECT doc_id, unnest(regexp_extract_all(lower({ascii_('text')}), '[a-z .]')) AS token FROM documents), lc AS (SELECT token, count(*) AS count FROM l GROUP BY token) {sql}"


def with_lines(sql: str) -> str:
    return f"""WITH x AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''),
    lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM x) {sql}"""


#: Counts are told forty-fold, as from a corpus of forty times the size, so that an offset of 35 is less than each.
TIMES, OFFSET = 40, 35


def _backoff_base(orders: int) -> str:
    """Sums, left-out tokens and running sums of the back-off model with an offset, of orders 1 to `orders`."""
    out = f"""
    u1 AS MATERIALIZED (SELECT w1, count * {TIMES} AS u, count * {TIMES} - {OFFSET} AS a, w1 <> '_START_' AS ok FROM k1),
    u2 AS MATERIALIZED (SELECT w1, w2, count * {TIMES} AS u, count * {TIMES} - {OFFSET} AS a, NOT (w2 = '_START_' OR (w1 = '_START_' AND w2 = '_END_')) AS ok FROM k2),
    p1 AS MATERIALIZED (SELECT w1, a, (sum(a) OVER (ORDER BY w1) - a)::BIGINT AS cum FROM u1 WHERE ok),
    p2 AS MATERIALIZED (SELECT w1, w2, a, (sum(a) OVER (PARTITION BY w1 ORDER BY w2) - a)::BIGINT AS cum FROM u2 WHERE ok),
    s1 AS MATERIALIZED (SELECT sum(u)::BIGINT AS acc, sum(a)::BIGINT AS adj FROM u1 WHERE ok),
    s2 AS MATERIALIZED (SELECT w1, coalesce(sum(u) FILTER (ok), 0)::BIGINT AS acc, coalesce(sum(a) FILTER (ok), 0)::BIGINT AS adj, coalesce(sum(u) FILTER (NOT ok), 0)::BIGINT AS rej FROM u2 GROUP BY 1),
    e1 AS MATERIALIZED (SELECT b, p1.w1 AS w, p1.a, p1.cum, (sum(p1.a) OVER (PARTITION BY b ORDER BY p1.w1) - p1.a)::BIGINT AS before, u1.u
           FROM (SELECT w1 AS b, w2 AS w FROM k2 UNION SELECT '_START_', '_END_') x JOIN p1 ON p1.w1 = x.w JOIN u1 ON u1.w1 = x.w),
    n1 AS MATERIALIZED (SELECT b, sum(u)::BIGINT AS u, sum(a)::BIGINT AS a FROM e1 GROUP BY 1)"""
    if orders == 3:
        out += f""",
    u3 AS MATERIALIZED (SELECT w1, w2, w3, count * {TIMES} AS u, count * {TIMES} - {OFFSET} AS a, NOT (w3 = '_START_' OR (w2 = '_START_' AND w3 = '_END_')) AS ok FROM k3),
    p3 AS MATERIALIZED (SELECT w1, w2, w3, a, (sum(a) OVER (PARTITION BY w1, w2 ORDER BY w3) - a)::BIGINT AS cum FROM u3 WHERE ok),
    s3 AS MATERIALIZED (SELECT w1, w2, coalesce(sum(u) FILTER (ok), 0)::BIGINT AS acc, coalesce(sum(a) FILTER (ok), 0)::BIGINT AS adj, coalesce(sum(u) FILTER (NOT ok), 0)::BIGINT AS rej FROM u3 GROUP BY 1, 2),
    e2 AS MATERIALIZED (SELECT u3.w1 AS b, u2.w1 AS c, u2.w2 AS w, u2.a, u2.u FROM u3 JOIN u2 ON u2.w1 = u3.w2 AND u2.w2 = u3.w3 WHERE u2.ok),
    n2 AS MATERIALIZED (SELECT b, c, sum(u)::BIGINT AS u, sum(a)::BIGINT AS a FROM e2 GROUP BY 1, 2)"""
    return out


def _weighed(adj: str, acc: str, tot: str) -> str:
    return f"CASE WHEN {acc} > 0 THEN ceil(CAST({adj} AS DOUBLE) / CAST({acc} AS DOUBLE) * (CAST({BETA} AS DOUBLE) * ({tot} - {acc}) + CAST({GAMMA} AS DOUBLE) * {tot}))::BIGINT END"


INTERVALS = f"WITH {_corpus(keyed=True)}, {_COUNTS}, {_CONSISTENT}, {_asked('benchmark', True)}," + _marks(f"""{_backoff_base(3)},
    each AS (SELECT CASE WHEN pos >= 3 THEN tokens[pos - 2] END AS c1, CASE WHEN pos >= 2 THEN tokens[pos - 1] END AS c2, tokens[pos] AS w FROM (SELECT tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM asked)),
    q AS MATERIALIZED (SELECT DISTINCT c1, c2, w, (w = '_START_' OR coalesce(c2 = '_START_' AND w = '_END_', false)) AS barred FROM each),
    g2 AS MATERIALIZED (SELECT q.c1, q.c2, q.w, max(g)::BIGINT AS gone FROM q JOIN (SELECT b, c, w, sum(a) OVER (PARTITION BY b, c ORDER BY w) AS g FROM e2) e ON e.b = q.c1 AND e.c = q.c2 AND e.w < q.w GROUP BY ALL),
    g1 AS MATERIALIZED (SELECT q.c2, q.w, max(e1.before + e1.a)::BIGINT AS gone FROM (SELECT DISTINCT c2, w FROM q) q JOIN e1 ON e1.b = q.c2 AND e1.w < q.w GROUP BY ALL),
    j AS (SELECT q.*, s3.acc AS acc3, s3.adj AS adj3, x3.u - s3.rej AS tot3, p3.a AS a3, p3.cum AS b3,
                 s2.acc - coalesce(n2.u, 0) AS acc2, s2.adj - coalesce(n2.a, 0) AS adj2, x2.u - s2.rej - coalesce(n2.u, 0) AS tot2, p2.a AS a2, p2.cum - coalesce(g2.gone, 0) AS b2,
                 (SELECT adj FROM s1) - coalesce(n1.a, 0) AS adj1, p1.a AS a1, p1.cum - coalesce(g1.gone, 0) AS b1
          FROM q LEFT JOIN s3 ON s3.w1 = q.c1 AND s3.w2 = q.c2 LEFT JOIN u2 x3 ON x3.w1 = q.c1 AND x3.w2 = q.c2 LEFT JOIN p3 ON p3.w1 = q.c1 AND p3.w2 = q.c2 AND p3.w3 = q.w
          LEFT JOIN s2 ON s2.w1 = q.c2 LEFT JOIN u1 x2 ON x2.w1 = q.c2 LEFT JOIN n2 ON n2.b = q.c1 AND n2.c = q.c2 LEFT JOIN p2 ON p2.w1 = q.c2 AND p2.w2 = q.w
          LEFT JOIN g2 ON g2.c1 = q.c1 AND g2.c2 = q.c2 AND g2.w = q.w LEFT JOIN n1 ON n1.b = q.c2 LEFT JOIN p1 ON p1.w1 = q.w LEFT JOIN g1 ON g1.c2 = q.c2 AND g1.w = q.w),
    f AS (SELECT *, adj2 + {_weighed('adj2', 'acc2', 'tot2')} AS f2, adj3 + {_weighed('adj3', 'acc3', 'tot3')} AS f3 FROM j),
    y1 AS (SELECT *, CASE WHEN a1 IS NOT NULL AND NOT barred AND adj1 > 0 THEN concat(b1, '/', b1 + a1, '/', adj1) END AS way1 FROM f),
    y2 AS (SELECT *, CASE WHEN a2 IS NOT NULL AND NOT barred THEN concat(b2, '/', b2 + a2, '/', f2) WHEN acc2 IS NULL OR acc2 <= 0 THEN way1 ELSE adj2 || '/' || f2 || '/' || f2 || ' ' || way1 END AS way2 FROM y1),
    y3 AS (SELECT *, CASE WHEN a3 IS NOT NULL AND NOT barred THEN concat(b3, '/', b3 + a3, '/', f3) WHEN acc3 IS NULL OR acc3 <= 0 THEN way2 ELSE adj3 || '/' || f3 || '/' || f3 || ' ' || way2 END AS way3 FROM y2)
    SELECT concat_ws(' ', c1[2:], c2[2:], w[2:]) AS ngram, coalesce(CASE WHEN c2 IS NULL THEN CASE WHEN w = '_START_' THEN '' END WHEN c1 IS NULL THEN way2 ELSE way3 END, '-') AS parts FROM y3
    """)

NEXT_BACKOFF = f"""WITH {_corpus(keyed=True)}, {_counted(1)}, {_counted(2)},
    k2 AS MATERIALIZED (SELECT * FROM t2),
    k1 AS MATERIALIZED (SELECT w1, max(count)::BIGINT AS count FROM (SELECT * FROM t1 UNION ALL SELECT w1, sum(count) FROM t2 GROUP BY 1 UNION ALL SELECT w2, sum(count) FROM t2 GROUP BY 1) GROUP BY 1),
    {_asked('benchmark', True)}, {_marks(_backoff_base(2))},
    q AS MATERIALIZED (SELECT c1, unnest([13, 500, 999])::HUGEINT AS num, unnest([1, 10, 1])::HUGEINT AS size, 1061::HUGEINT AS den FROM (SELECT DISTINCT g[1] AS c1 FROM (SELECT {windows(2)} AS g FROM asked))),
    f AS (SELECT q.*, s2.acc, s2.adj, {_weighed('s2.adj', 's2.acc', '(u1.u - s2.rej)')} AS v FROM q LEFT JOIN s2 ON s2.w1 = c1 LEFT JOIN u1 ON u1.w1 = c1),
    l2 AS MATERIALIZED (SELECT *, (num * (adj + v)) // den AS lo, ((num + size) * (adj + v) + den - 1) // den AS hi FROM f),
    w2 AS (SELECT c1, num, p2.w2 AS w, 2 AS level FROM l2 JOIN p2 ON p2.w1 = c1 AND p2.cum <= lo AND p2.cum + p2.a >= hi WHERE acc > 0 AND hi <= adj),
    r AS (SELECT c1, num AS id, num, num + size AS upto, den FROM l2 WHERE coalesce(acc, 0) <= 0
          UNION ALL SELECT c1, num, num * (adj + v) - adj * den, (num + size) * (adj + v) - adj * den, den * v FROM l2 WHERE acc > 0 AND lo >= adj AND v > 0),
    t AS (SELECT r.*, (SELECT adj FROM s1) - coalesce(n1.a, 0) AS top FROM r LEFT JOIN n1 ON n1.b = c1),
    l1 AS MATERIALIZED (SELECT c1, id, (num * top) // den AS lo, (upto * top + den - 1) // den AS hi FROM t WHERE top > 0),
    gone AS MATERIALIZED (SELECT l1.c1, id, max(before + a)::BIGINT AS g FROM l1 JOIN e1 ON e1.b = l1.c1 AND e1.cum - e1.before <= l1.lo GROUP BY ALL),
    spot AS MATERIALIZED (SELECT l1.c1, l1.id, (lo + coalesce(g, 0))::BIGINT AS lo, (hi + coalesce(g, 0))::BIGINT AS hi FROM l1 LEFT JOIN gone USING (c1, id)),
    a1 AS (SELECT spot.*, p1.w1 AS w, p1.cum + p1.a AS ends FROM spot ASOF JOIN p1 ON spot.lo >= p1.cum),
    found AS (SELECT * FROM w2 UNION ALL SELECT c1, id, w, 1 FROM a1 WHERE ends >= hi)
    SELECT q.c1[2:] AS context, q.num::BIGINT AS num, coalesce(w[2:], '') AS word, coalesce(level, 0)::INT AS level FROM q LEFT JOIN found USING (c1, num)
    """

REPORT = f"""WITH ways AS ({INTERVALS}), {_asked('benchmark')},
    each AS (SELECT item_id, sent, concat_ws(' ', CASE WHEN pos >= 3 THEN tokens[pos - 2] END, CASE WHEN pos >= 2 THEN tokens[pos - 1] END, tokens[pos]) AS ngram FROM (SELECT item_id, sent, tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM asked)),
    bits AS (SELECT ngram, parts = '-' AS never, coalesce(list_sum(list_transform(list_filter(string_split(parts, ' '), lambda p: p NOT IN ('', '-')), lambda p: log2(string_split(p, '/')[3]::DOUBLE) - log2((string_split(p, '/')[2]::BIGINT - string_split(p, '/')[1]::BIGINT)::DOUBLE))), 0) AS bits FROM ways),
    told AS (SELECT item_id, sent, CASE WHEN NOT bool_or(never) THEN sum(bits) END AS entropy FROM each JOIN bits USING (ngram) GROUP BY ALL)
    SELECT item_id, sent::INT AS sent, len(tokens)::INT AS n_tokens, array_to_string(tokens[2:len(tokens) - 1], ' ') AS text, round(coalesce(entropy, -1), 4) AS entropy, entropy IS NOT NULL AS told FROM asked JOIN told USING (item_id, sent)
    """

DECODED = f"""WITH ways AS ({INTERVALS}), {_asked('benchmark')},
    each AS (SELECT item_id, sent, pos, tokens[pos] AS word, concat_ws(' ', CASE WHEN pos >= 3 THEN tokens[pos - 2] END, CASE WHEN pos >= 2 THEN tokens[pos - 1] END, tokens[pos]) AS ngram FROM (SELECT item_id, sent, tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM asked)),
    told AS (SELECT item_id, sent FROM each JOIN ways USING (ngram) GROUP BY ALL HAVING NOT bool_or(parts = '-'))
    SELECT item_id, sent::INT AS sent, pos::INT - 1 AS pos, word FROM each JOIN told USING (item_id, sent)
    """
