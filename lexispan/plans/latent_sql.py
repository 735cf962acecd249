"""SQL of the latent lexicon: lines to graphs by joins, forward and backward sums by recursion.

Every phoneme is one private character, so units are letters of a string.  A
segment's nodes are numbered in topological order; a sweep appends one node's sum at
each step to the list of those before it.
"""

from __future__ import annotations

import unicodedata

from lexispan.functions.letters import DEVANAGARI_CONSONANTS, DEVANAGARI_SIGNS, DEVANAGARI_VOWELS, VIRAMA
from lexispan.functions.phonology import LONGEST_FIRST, OF_IAST, PHONEMES
from lexispan.functions.script import MARKS
from lexispan.operators import rules
from lexispan.plans.statistics import SEGMENTS

_CODE = {name: chr(0xE100 + k) for k, name in enumerate(PHONEMES)}
_VOWELS = "".join(c for name, c in _CODE.items() if name.startswith("V_"))
_ALL = "".join(_CODE.values())
_SPACES = r"\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_q = lambda x: "'" + x.replace("'", "''") + "'"


def _coded(iast: str) -> str:
    """An IAST string by its private characters; marks stay."""
    out, at = "", 0
    while at < len(iast):
        piece = next((p for p in LONGEST_FIRST if iast.startswith(p, at)), None)
        out += _CODE[OF_IAST[piece]] if piece else iast[at]
        at += len(piece) if piece else 1
    return out


def _to_iast(x: str) -> str:
    """Devanagari as IAST; other characters stay."""
    inherent = ""
    x = f"regexp_replace(nfc_normalize({x}), '([{''.join(DEVANAGARI_CONSONANTS)}])', '\\1{inherent}', 'g')"
    x = f"replace(regexp_replace({x}, '{inherent}([{''.join(DEVANAGARI_SIGNS)}{VIRAMA}])', '\\1', 'g'), '{inherent}', 'a')"
    for table in (DEVANAGARI_CONSONANTS, DEVANAGARI_SIGNS, DEVANAGARI_VOWELS, {v: k for k, v in MARKS.items()}):
        for deva, iast in table.items():
            x = f"replace({x}, '{deva}', {_q(iast)})"
    return f"replace({x}, '{VIRAMA}', '')"


def _encoded(x: str) -> str:
    """IAST without grave and acute (in whatever letter they are), in private characters."""
    bare = {}
    for cp in range(0x80, 0x2000):
        split = unicodedata.normalize("NFD", chr(cp))
        if ("̀" in split or "́" in split) and len(kept := unicodedata.normalize("NFC", split.replace("̀", "").replace("́", ""))) == 1 and kept != chr(cp):
            bare[chr(cp)] = kept
    x = f"translate(regexp_replace(nfc_normalize({x}), '[\\x{{0300}}\\x{{0301}}]', '', 'g'), {_q(''.join(bare))}, {_q(''.join(bare.values()))})"
    x = f"nfc_normalize({x})"
    for old, new in (("r̥̄", "ṝ"), ("r̥", "ṛ"), ("l̥̄", "ḹ"), ("l̥", "ḷ"), ("ṁ", "ṃ"), ("ē", "e"), ("ō", "o"), ("’", "'"), ("ʼ", "'"), ("ऽ", "'")):
        x = f"replace({x}, {_q(unicodedata.normalize('NFC', old))}, {_q(new)})"
    for iast in (p for p in LONGEST_FIRST if len(p) > 1):
        x = f"replace({x}, '{iast}', '{_CODE[OF_IAST[iast]]}')"
    single = [p for p in LONGEST_FIRST if len(p) == 1]
    return f"translate({x}, '{''.join(single)}', '{''.join(_CODE[OF_IAST[p]] for p in single)}')"


def _grammar() -> str:
    inner, across = [], []
    for rule_id, left, right, surface, *_ in rules.seed_rules():
        l, r, atoms = _coded(left), _coded(right), _coded(surface)
        if "#" in atoms:
            a, b = atoms.split("#")
            across.append((a, b, l, r, rule_id))
            continue
        inner.append((atoms, l, r, rule_id))
        for at in range(1, len(atoms)):
            if "'" in atoms[at - 1 : at + 1]:
                across.append((atoms[:at], atoms[at:], l, r, rule_id))
    values = lambda rows: ", ".join(f"({', '.join(map(_q, x))})" for x in rows)
    return f"inner_rules(surface, l, r, rule_id) AS (VALUES {values(inner)}), across_rules(a, b, l, r, rule_id) AS (VALUES {values(across)})"


_NAMES = ", ".join(f"'{c}': '{name}'" for name, c in _CODE.items())
KEY = f"array_to_string(list_transform(string_split({{0}}, ''), lambda x: (MAP {{{{{_NAMES}}}}})[x]), '.')"

#: `graph_segments` (sid, toks, n), `line_segments` (segment_id, segment_no, sid), `arcs` (sid, f, g, word, identity, merged) and `ends` (sid, last).
GRAPHS = f"""{SEGMENTS}, {_grammar()},
written AS (SELECT segment_id, {_encoded(f"lower(CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN {_to_iast('text')} ELSE nfc_normalize(text) END)")} AS t FROM segments WHERE text IS NOT NULL),
pieces AS (SELECT segment_id, i, trim(regexp_replace(ps[i], '[{_SPACES}]+', ' ', 'g'), ' ') AS piece FROM (SELECT segment_id, regexp_split_to_array(t, '[^{_ALL}''{_SPACES}]+') AS ps FROM written), unnest(generate_series(1, len(ps))) AS u(i)),
numbered AS (SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY i) - 1 AS segment_no, piece FROM pieces WHERE piece <> ''),
graph_segments AS MATERIALIZED (SELECT row_number() OVER (ORDER BY piece) AS sid, piece, string_split(piece, ' ') AS toks, len(string_split(piece, ' ')) AS n FROM (SELECT DISTINCT piece FROM numbered)),
line_segments AS MATERIALIZED (SELECT segment_id, segment_no, sid FROM numbered JOIN graph_segments USING (piece)),
tk AS MATERIALIZED (SELECT sid, i, toks[i + 1] AS u, length(toks[i + 1]) AS n, n AS k FROM graph_segments, unnest(generate_series(0, n - 1)) AS x(i)),
tokens AS MATERIALIZED (SELECT DISTINCT u FROM tk),
tm AS MATERIALIZED (SELECT u, row_number() OVER (PARTITION BY u ORDER BY s, e, l, r) AS k, s, e, l, r, ids FROM
  (SELECT u, s, s + length(surface) AS e, l, r, list(rule_id) AS ids FROM (SELECT u, s FROM tokens, unnest(generate_series(0, length(u) - 1)) AS x(s)) JOIN inner_rules ON starts_with(substr(u, s + 1), surface) GROUP BY u, s, s + length(surface), l, r)),
ti AS MATERIALIZED (SELECT a.u, a.k AS k1, b.k AS k2, a.r || substr(a.u, a.e + 1, b.s - a.e) || b.l AS word FROM tm a JOIN tm b ON a.u = b.u AND b.s >= a.e WHERE NOT contains(substr(a.u, a.e + 1, b.s - a.e), '''')),
meets AS (SELECT DISTINCT a.u, b.u AS v FROM tk a JOIN tk b ON a.sid = b.sid AND b.i = a.i + 1),
ruled AS (SELECT u, v, length(a) AS tl, length(b) AS tr, l, r, NOT bool_or(NOT contains(a || b, '''') AND a = l AND b = r) AS changed, list(rule_id) AS ids FROM meets JOIN across_rules ON ends_with(u, a) AND starts_with(v, b)
  WHERE NOT (ends_with(u, '''') AND a = '') AND NOT (starts_with(v, '''') AND b = '') GROUP BY u, v, length(a), length(b), l, r),
op AS MATERIALIZED (SELECT u, v, tl, tr, l, r, changed, ids FROM ruled UNION ALL SELECT u, v, 0, 0, '', '', false, [] FROM meets WHERE (u, v) NOT IN (SELECT (u, v) FROM ruled WHERE NOT changed)),
choices AS MATERIALIZED (
  SELECT a.sid, b.i AS b, row_number() OVER (PARTITION BY a.sid, b.i ORDER BY tl, tr, l, r) AS o, tl, tr, l, r, changed, ids FROM tk a JOIN tk b ON a.sid = b.sid AND b.i = a.i + 1 JOIN op ON op.u = a.u AND op.v = b.u
  UNION ALL SELECT sid, 0, 1, 0, 0, '', '', false, [] FROM graph_segments UNION ALL SELECT sid, n, 1, 0, 0, '', '', false, [] FROM graph_segments),
nodes AS MATERIALIZED (SELECT sid, ord, idx, ids, cue, row_number() OVER (PARTITION BY sid ORDER BY ord, idx) - 1 AS node FROM
  (SELECT sid, 2 * b AS ord, o AS idx, ids, 'space' AS cue FROM choices UNION ALL SELECT sid, 2 * i + 1, k, ids, cue FROM (SELECT sid, i, tm.k, ids, CASE WHEN contains(substr(u, s + 1, e - s), '''') THEN 'avagraha' ELSE 'unmarked' END AS cue FROM tk JOIN tm USING (u)))),
ends AS MATERIALIZED (SELECT sid, max(node) AS last FROM nodes GROUP BY sid),
drawn AS (
  SELECT sid, 2 * i + 1 AS o1, k1 AS x1, 2 * i + 1 AS o2, k2 AS x2, word, false AS identity, false AS merged FROM tk JOIN ti USING (u) WHERE regexp_matches(word, '[{_VOWELS}]')
  UNION ALL SELECT t.sid, 2 * i, c.o, 2 * i + 1, m.k, c.r || substr(t.u, c.tr + 1, m.s - c.tr) || m.l, false, false FROM tk t JOIN choices c ON c.sid = t.sid AND c.b = t.i JOIN tm m ON m.u = t.u AND m.s >= c.tr
    WHERE NOT contains(substr(t.u, c.tr + 1, m.s - c.tr), '''') AND regexp_matches(c.r || substr(t.u, c.tr + 1, m.s - c.tr) || m.l, '[{_VOWELS}]')
  UNION ALL SELECT t.sid, 2 * i + 1, m.k, 2 * i + 2, c.o, m.r || substr(t.u, m.e + 1, t.n - c.tl - m.e) || c.l, false, false FROM tk t JOIN choices c ON c.sid = t.sid AND c.b = t.i + 1 JOIN tm m ON m.u = t.u AND m.e <= t.n - c.tl
    WHERE NOT contains(substr(t.u, m.e + 1, t.n - c.tl - m.e), '''') AND regexp_matches(m.r || substr(t.u, m.e + 1, t.n - c.tl - m.e) || c.l, '[{_VOWELS}]')
  UNION ALL SELECT t.sid, 2 * i, a.o, 2 * i + 2, c.o, a.r || replace(substr(t.u, a.tr + 1, t.n - c.tl - a.tr), '''', '') || c.l, NOT a.changed AND NOT c.changed, false
    FROM tk t JOIN choices a ON a.sid = t.sid AND a.b = t.i JOIN choices c ON c.sid = t.sid AND c.b = t.i + 1 WHERE a.tr <= t.n - c.tl
  UNION ALL SELECT t.sid, 2 * t.i, a.o, 2 * t.i + 4, c.o, a.r || substr(t.u, a.tr + 1) || substr(v.u, 1, v.n - c.tl) || c.l, false, true
    FROM tk t JOIN tk v ON v.sid = t.sid AND v.i = t.i + 1 JOIN choices a ON a.sid = t.sid AND a.b = t.i JOIN choices c ON c.sid = t.sid AND c.b = t.i + 2
    WHERE NOT contains(t.u || v.u, '''') AND a.tr <= t.n AND c.tl <= v.n AND regexp_matches(a.r || substr(t.u, a.tr + 1) || substr(v.u, 1, v.n - c.tl) || c.l, '[{_VOWELS}]')),
arcs AS MATERIALIZED (SELECT d.sid, f.node AS f, g.node AS g, word, identity, merged FROM drawn d JOIN nodes f ON f.sid = d.sid AND f.ord = o1 AND f.idx = x1 JOIN nodes g ON g.sid = d.sid AND g.ord = o2 AND g.idx = x2 WHERE word <> '')"""


def sweeps(name: str, scored: str) -> str:
    """Of scored arcs (sid, f, g, w, same): `{name}_mass` with each arc's probability, and `{name}_z` (sid, z, same, best) with sums over all analyses, those as written, and the best one."""
    return f"""
{name}_in AS MATERIALIZED (SELECT sid, g AS at, list({{'f': f + 1, 'w': w, 's': CASE WHEN identity THEN w ELSE 0.0 END}}) AS fan FROM {scored} GROUP BY ALL),
{name}_out AS MATERIALIZED (SELECT sid, last - f AS at, list({{'f': last - g + 1, 'w': w}}) AS fan FROM {scored} JOIN ends USING (sid) GROUP BY ALL),
{name}_fwd(sid, t, last, a, s, b) AS (
  SELECT sid, 0::BIGINT, last, [1.0::DOUBLE], [1.0::DOUBLE], [1.0::DOUBLE] FROM ends
  UNION ALL
  SELECT x.sid, x.t + 1, x.last, list_append(x.a, coalesce(list_sum(list_transform(fan, lambda y: x.a[y.f] * y.w)), 0.0)), list_append(x.s, coalesce(list_sum(list_transform(fan, lambda y: x.s[y.f] * y.s)), 0.0)),
    list_append(x.b, coalesce(list_max(list_transform(fan, lambda y: x.b[y.f] * y.w)), 0.0))
  FROM {name}_fwd x LEFT JOIN {name}_in i ON i.sid = x.sid AND i.at = x.t + 1 WHERE x.t < x.last),
{name}_bwd(sid, t, last, a) AS (
  SELECT sid, 0::BIGINT, last, [1.0::DOUBLE] FROM ends
  UNION ALL
  SELECT x.sid, x.t + 1, x.last, list_append(x.a, coalesce(list_sum(list_transform(fan, lambda y: x.a[y.f] * y.w)), 0.0)) FROM {name}_bwd x LEFT JOIN {name}_out i ON i.sid = x.sid AND i.at = x.t + 1 WHERE x.t < x.last),
{name}_z AS MATERIALIZED (SELECT sid, last, a, a[-1] AS z, s[-1] AS same, b[-1] AS best FROM {name}_fwd WHERE t = last AND a[-1] > 0),
{name}_mass AS MATERIALIZED (SELECT r.sid, g, word, w, z.a[f + 1] * w * y.a[z.last - g + 1] / z AS mass FROM {scored} r JOIN {name}_z z ON z.sid = r.sid JOIN (SELECT sid, a FROM {name}_bwd WHERE t = last) y ON y.sid = r.sid)"""


_TIMES = "times AS (SELECT sid, count(*) AS times FROM line_segments GROUP BY sid)"
NEUTRAL = f"{GRAPHS}, {_TIMES}, first_arcs AS MATERIALIZED (SELECT *, CASE WHEN merged THEN exp(-8.0) ELSE 1.0 END AS w FROM arcs), {sweeps('first', 'first_arcs')}, first_counts AS MATERIALIZED (SELECT word, sum(mass * times) AS n FROM first_mass JOIN times USING (sid) GROUP BY word HAVING sum(mass * times) > 0)"
_SCORE = "ln(greatest((n + 0.1) / (t + 0.1 * v), 1e-300)) - 0.5 * ln(1 + 1 / (1 + n))"


def scores(counts: str) -> str:
    """(word, score) of a lexicon (word, n)."""
    return f"(SELECT word, {_SCORE} AS score FROM {counts}, (SELECT sum(n) AS t, count(*) AS v FROM {counts}))"


SECOND = f"""{NEUTRAL}, second_arcs AS MATERIALIZED (SELECT a.sid, f, g, a.word, identity, merged, exp(score - CASE WHEN merged THEN 8.0 ELSE 0.0 END) AS w FROM arcs a JOIN {scores('first_counts')} USING (word)),
{sweeps('second', 'second_arcs')}, second_counts AS (SELECT word, sum(mass * times) AS n FROM second_mass JOIN times USING (sid) GROUP BY word HAVING sum(mass * times) > 0)"""

# Inspection under a vocabulary of 2,000 forms, chosen by the rounded counts of the first pass.
BUDGET = 2000
INSPECTED = f"""{NEUTRAL}, rounded AS (SELECT word, {KEY.format('word')} AS form_key, round(n + 1e-9, 6) AS n FROM first_counts),
kept AS (SELECT word, n FROM rounded WHERE length(word) > 1 ORDER BY n DESC, form_key LIMIT {BUDGET - len(PHONEMES)}),
parts AS (SELECT unnest(string_split(word, '')) AS word, n FROM rounded WHERE word NOT IN (SELECT word FROM kept)),
base(word) AS (VALUES {", ".join(f"('{c}')" for c in _CODE.values())}),
vocabulary AS MATERIALIZED (SELECT word, n FROM kept UNION ALL SELECT b.word, coalesce(sum(p.n), 0.0) FROM base b LEFT JOIN parts p USING (word) GROUP BY b.word),
vocabulary_scores AS MATERIALIZED {scores('vocabulary')},
words AS (SELECT DISTINCT word FROM arcs),
word_scores AS MATERIALIZED (SELECT w.word, s.score, 1 AS tokens FROM words w JOIN vocabulary_scores s USING (word)
  UNION ALL SELECT w.word, sum(s.score), count(*) FROM (SELECT word, unnest(string_split(word, '')) AS p FROM words WHERE word NOT IN (SELECT word FROM vocabulary)) w JOIN vocabulary_scores s ON s.word = w.p GROUP BY w.word),
seen_arcs AS MATERIALIZED (SELECT a.sid, f, g, a.word, identity, merged, exp(score - CASE WHEN merged THEN 8.0 ELSE 0.0 END) AS w FROM arcs a JOIN word_scores USING (word)),
{sweeps('seen', 'seen_arcs')},
per_segment AS MATERIALIZED (SELECT sid, ln(z) AS log_partition, greatest(0, ln(z) - e) AS entropy, least(1, same / z) AS identity_mass, tokens AS expected_tokens, arcs, best / z AS top_probability
  FROM seen_z JOIN (SELECT sid, sum(CASE WHEN mass > 0 THEN mass * ln(w) ELSE 0 END) AS e, sum(mass * tokens) AS tokens, count(*) AS arcs FROM seen_mass JOIN word_scores USING (word) GROUP BY sid) USING (sid))"""
_R = "round({0} + 1e-9, 6) AS {0}"
SQL = {
    "latent_training_pass": f"WITH RECURSIVE {NEUTRAL} SELECT {KEY.format('word')} AS form_key, round(n + 1e-9, 6) AS expected_count FROM first_counts",
    "latent_em": f"WITH RECURSIVE {SECOND} SELECT {KEY.format('word')} AS form_key, round(n + 1e-9, 6) AS expected_count FROM second_counts",
    "latent_inspection": f"""WITH RECURSIVE {INSPECTED} SELECT segment_id AS key, CAST(segment_no AS INTEGER) AS segment_no, {", ".join(_R.format(c) for c in ("log_partition", "entropy", "identity_mass", "expected_tokens", "top_probability"))}, CAST(arcs AS INTEGER) AS arcs
FROM line_segments JOIN per_segment USING (sid)""",
    "latent_rule_usage": f"""WITH RECURSIVE {INSPECTED}, r AS (SELECT unnest(ids) AS rule_id, mass * times / len(ids) AS mass FROM seen_mass m JOIN nodes n ON n.sid = m.sid AND n.node = m.g JOIN times ON times.sid = m.sid WHERE mass > 0)
SELECT rule_id, round(sum(mass) + 1e-9, 6) AS expected_usage FROM r GROUP BY rule_id""",
    "latent_boundaries": f"""WITH RECURSIVE {INSPECTED}, b AS (SELECT m.sid, ord, CASE WHEN cue = 'space' THEN 0 ELSE idx END AS idx, cue, least(1, sum(mass)) AS p FROM seen_mass m JOIN nodes n ON n.sid = m.sid AND n.node = m.g JOIN ends e ON e.sid = m.sid WHERE mass > 0 AND g < last GROUP BY ALL)
SELECT cue AS cue_kind, CAST(sum(times) AS BIGINT) AS boundaries, round(sum(p * times) + 1e-9, 6) AS expected, CAST(sum(times) FILTER (WHERE p >= 0.9) AS BIGINT) AS confident FROM b JOIN times USING (sid) GROUP BY cue""",
    "latent_pass_metrics": f"""WITH RECURSIVE {INSPECTED} SELECT count(*) AS segments, round(sum(log_partition) + 1e-9, 6) AS log_partition, round(sum(expected_tokens) + 1e-9, 6) AS expected_tokens, CAST(sum(arcs) AS BIGINT) AS arcs,
  round(avg(identity_mass) + 1e-9, 6) AS mean_identity_mass, round(avg(entropy) + 1e-9, 6) AS mean_entropy, CAST(0 AS BIGINT) AS overflowed FROM line_segments JOIN per_segment USING (sid)""",
    "latent_segment_export": f"""WITH RECURSIVE {INSPECTED} SELECT segment_id AS key, CAST(segment_no AS INTEGER) AS segment_no, g.n AS tokens, {", ".join(_R.format(c) for c in ("top_probability", "identity_mass", "entropy"))}, round(1 - identity_mass + 1e-9, 6) AS latent_mass
FROM line_segments JOIN per_segment USING (sid) JOIN graph_segments g USING (sid)""",
    "latent_scalars": f"""WITH RECURSIVE {INSPECTED} SELECT count(*) AS segments, count(DISTINCT segment_id) AS lines, round(sum(expected_tokens) + 1e-9, 6) AS expected_tokens, round(sum(log_partition) + 1e-9, 6) AS log_partition, round(avg(identity_mass) + 1e-9, 6) AS mean_identity_mass,
  round(avg(entropy) + 1e-9, 6) AS mean_entropy, (SELECT count(*) FROM vocabulary) AS forms, (SELECT round(sum(n) + 1e-9, 6) FROM vocabulary) AS mass, (SELECT count(*) FILTER (WHERE n > 0) FROM vocabulary) AS active_forms FROM line_segments JOIN per_segment USING (sid)""",
}


def strata(cell: str, tokens: list[float], entropy: list[float]) -> str:
    """SQL of archive.segment_strata over the inspected segments, by an expression of segment_id."""
    case = lambda c, edges: "CASE " + " ".join(f"WHEN {c} <= {e} THEN {k}" for k, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    return f"""WITH RECURSIVE {INSPECTED} SELECT {cell} AS cell, CAST({case("g.n", tokens)} AS INTEGER) AS token_stratum, CAST({case("entropy", entropy)} AS INTEGER) AS entropy_stratum, count(*) AS segments,
  round(sum(identity_mass) + 1e-9, 6) AS identity_mass, round(sum(expected_tokens) + 1e-9, 6) AS expected_tokens FROM line_segments JOIN per_segment USING (sid) JOIN graph_segments g USING (sid) GROUP BY ALL"""
