"""SQL that gives the same rows as the queries, for the operators that SQL can express."""

from __future__ import annotations

from . import chat, licenses, mixing, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"


def _count(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"


def op3() -> str:
    white = r"[\x20\x09-\x0D]"
    of = {"symbol_rate": ("n_symbols", "n_words", 1), "dup_line_rate": ("n_dup_lines", "n_lines", 1), "repeat_rate": ("n_repeat_words", "n_words", 6), "upper_rate": ("n_upper", "word_chars", 1)}
    low = lambda n, w, k: f"(greatest({n} - sqrt({n} * {k}.0::DOUBLE), 0) / ({w} + 1))"
    high = lambda n, w, k: f"(({n} + sqrt({n} * {k}.0::DOUBLE) + {k}) / ({w} + 1))"
    rates = ", ".join(f"{low(*x)} AS {r}_low, {high(*x)} AS {r}_high" for r, x in of.items())
    bins = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, CAST(floor(ln({r}_high / {quality.UNIT}) / ln({quality.GAMMA})) AS INTEGER) AS bin FROM m WHERE NOT base_failed" for r in of)
    top = lambda q: f"{quality.UNIT} * pow({quality.GAMMA}, min(CASE WHEN 100 * run >= {q} * total THEN bin END) + 1)"
    limits = ", ".join(f"max(CASE WHEN rate = '{r}' THEN lim END) AS {r}_l" for r in of)
    good = " AND ".join(f"coalesce(m.{r}_low <= l.{r}_l, false)" for r in of)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
c AS (SELECT *, len(w) AS n, length(regexp_replace(t, '{white}', '', 'g')) AS word_chars, {_count("[#*$%&|<>]")} AS n_symbols, {_count("[A-Z]")} AS n_upper, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) x),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM win) y WHERE k > 1) z GROUP BY rid),
e AS (SELECT c.rid, doc_id, lang, source, c.n AS n_words, word_chars, n_symbols, n_upper, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM c LEFT JOIN rep ON rep.rid = c.rid),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM e),
b AS ({bins}),
g AS (SELECT lang, source, rate, bin, count(*)::HUGEINT AS n FROM b GROUP BY ALL),
a AS (SELECT rate, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rate) AS total FROM g GROUP BY rate, bin),
lang0 AS (SELECT lang, rate, bin, sum(n) AS n FROM g GROUP BY ALL),
lang1 AS (SELECT x.lang, x.rate, x.bin, x.n * t.total AS n FROM lang0 x JOIN (SELECT DISTINCT rate, total FROM a) t ON t.rate = x.rate UNION ALL SELECT x.lang, a.rate, a.bin, {quality.PRIOR} * a.n FROM (SELECT DISTINCT lang, rate FROM lang0) x JOIN a ON a.rate = x.rate),
p AS (SELECT lang, rate, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, rate) AS total FROM lang1 GROUP BY lang, rate, bin),
g1 AS (SELECT x.lang, x.source, x.rate, x.bin, x.n * t.total AS n FROM g x JOIN (SELECT DISTINCT lang, rate, total FROM p) t ON t.lang IS NOT DISTINCT FROM x.lang AND t.rate = x.rate
  UNION ALL SELECT x.lang, x.source, p.rate, p.bin, {quality.PRIOR} * p.n FROM (SELECT DISTINCT lang, source, rate FROM g) x JOIN p ON p.lang IS NOT DISTINCT FROM x.lang AND p.rate = x.rate),
g2 AS (SELECT lang, source, rate, bin, sum(n) AS n FROM g1 GROUP BY ALL),
r AS (SELECT lang, source, rate, bin, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bin) AS run, sum(n) OVER (PARTITION BY lang, source, rate) AS total FROM g2),
q AS (SELECT lang, source, rate, least({top(quality.UPPER)}, {quality.REACH} * {top(50)}) AS lim FROM r GROUP BY ALL),
l AS (SELECT lang, source, {limits} FROM q GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {good} AS kept
FROM m LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op4() -> str:
    """Its rules are written out here, apart from the operator's; only the known wordings are shared."""
    words = "licenc licens acknowledgement acknowledgment analogue analog authoris authoriz favour favor honour honor judgement judgment organis organiz recognis recogniz utilis utiliz whilst while wilful willful".split()
    holder = r"copyright[ \t]*(?:\(c\)|©|[0-9]|by )|\(c\)[ \t]*(?:copyright|[0-9])|©"
    opening = "permission is|redistribution and|licen[cs]ed under|released under|this software|this work|this program"

    def plain(text: str) -> str:
        out = f"lower_ascii({text})"
        out = f"regexp_replace({out}, '(^|\n)[ \t]*(?:{holder})(?:[^\n]*?[ \t]({opening})\\b|[^\n]*)', '\\1 \\2', 'g')"
        out = f"regexp_replace({out}, '(^|\n)[ \t]*all rights reserved', '\\1', 'g')"
        for x, y in zip(words[::2], words[1::2], strict=True):
            out = f"replace({out}, '{x}', '{y}')"
        return out.replace("lower_ascii(" + text + ")", f"translate({text}, '{licenses.UPPER}', '{licenses.LOWER}')")

    def form(text: str) -> str:
        """Of a plain text or line: the words, one space apart."""
        out = f"regexp_replace(' ' || {text} || ' ', '[\\x00-\\x20\\x21-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')"
        out = f"regexp_replace(regexp_replace(regexp_replace({out}, 'sub licens', 'sublicens', 'g'), 'non commercial', 'noncommercial', 'g'), 'per cent', 'percent', 'g')"
        return f"regexp_replace({out}, ' (?:version|ver|v) ?([0-9])', ' v\\1', 'g')"

    known = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN)
    return f"""WITH k AS (SELECT sha256({form(plain('x'))}) AS d, min(n) AS license FROM (VALUES {known}) v(n, x) GROUP BY 1),
t AS (SELECT row_number() OVER () AS rid, doc_id, {plain("coalesce(text, '')")} AS x FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN {form('x')} <> ' ' THEN sha256({form('x')}) END AS digest FROM t),
n AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM (SELECT rid, unnest(string_split(x, chr(10))) AS line FROM t) u JOIN k ON k.d = sha256({form('line')}) GROUP BY rid)
SELECT doc_id, digest, k.license, coalesce(n.n, 0) AS n_license_lines, coalesce(names, '') AS line_licenses, k.license IS NOT NULL AS is_license FROM g LEFT JOIN k ON k.d = g.digest LEFT JOIN n ON n.rid = g.rid"""


def op5() -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0) x),
z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.rid = a JOIN z y ON y.rid = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS id, rid AS other FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT r.id AS rid, min(o.doc_id) AS component FROM r JOIN d o ON o.rid = r.other GROUP BY r.id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component AS component_id, c.component IS NOT DISTINCT FROM d.doc_id AS kept FROM d JOIN c ON c.rid = d.rid LEFT JOIN z ON z.rid = d.rid"""


def op8() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
x AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) t),
h AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM x) t WHERE k > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM h),
kept AS (SELECT w.rid, string_agg(w.word, ' ' ORDER BY w.p) AS t, count(*) AS n FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) w ANTI JOIN gone ON gone.rid = w.rid AND gone.p = w.p GROUP BY w.rid)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.rid = d.rid"""


def op9() -> str:
    u = f"CAST(('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''), '{mixing.SEED}')), 1, 13)) AS BIGINT) / {16**13}.0"
    return f"""WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*), {mixing.TEMPERATURE}) AS weight FROM documents GROUP BY source),
r AS (SELECT source, round(weight / sum(weight) OVER () * (sum(n) OVER ()) / n, 9) AS rate FROM n),
q AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM q WHERE k < 120),
d AS (SELECT *, {u} AS u FROM documents),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, q.rate, min(CASE WHEN q.c > d.u THEN q.k END) AS copies, d.u FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, rate AS mix_rate, CAST(copies AS INTEGER) AS mix_copies, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS mix_copy FROM m"""


def op11() -> str:
    """Every share of every term in every source, without an index."""
    share = "1 + (1000000000::HUGEINT * (coalesce({n}, 0) + 2)) // ({total} + 2 * v)"
    apart = "((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(t.total), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, c.n, {share.format(n="c.n", total="g.total")} AS p FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT c.lang, c.term, {share.format(n="sum(c.n)", total="any_value(t.total)")} AS p FROM (SELECT c.*, v.v FROM c JOIN v ON v.lang = c.lang) c JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) t ON t.lang = c.lang GROUP BY c.lang, c.term, v),
f AS (SELECT x.lang, x.source, y.source AS item, sum({apart}) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT x.lang, x.source, 'term' AS part, x.term AS item, CAST({apart} AS BIGINT) AS value FROM p x JOIN q y ON x.lang = y.lang AND x.term = y.term WHERE x.n > 0 AND x.p > y.p)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) u) z WHERE part = 'pair' OR rank <= 10"""


def op12() -> str:
    said = "</s>[INST] ok [/INST]"
    # What the template adds: [INST]  [/INST], a space and </s>, [ROLE][TEXT][/ROLE] and the role; each escape is one character.
    escapes = lambda x: f"len(regexp_extract_all({x}, '{chat.CONTROL}'))"
    added = f"CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 19 + length(role) + {escapes('role')} END"
    order = "ORDER BY turn NULLS FIRST, role, text"
    loss = f"coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')"
    return f"""WITH c AS (SELECT false AS own, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT true, -7, 0, 'user', '{said}' UNION ALL SELECT true, -7, 1, 'assistant', '{said}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, length({loss}) AS loss_chars, sha256({loss}) AS loss_sha256,
CAST(3 + sum({added} + length(text) + {escapes('text')}) AS BIGINT) AS formatted_chars FROM c GROUP BY own, conv_id"""


ORACLES = {"op3_quality_rules": op3(), "op4_license_scan": op4(), "op5_minhash_near_dedup": op5(), "op8_substring_dedup": op8(), "op9_mixing": op9(), "op11_source_divergence": op11(), "op12_chat_formatting": op12()}
