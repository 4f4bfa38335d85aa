"""SQL, for a plain engine, that must give the same rows as the native corpus queries."""

from __future__ import annotations

from itertools import permutations

from flowlens.llm import filter_audit as A, licenses as L, quality_rules as Q


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(values) + "]"


def quality_rules() -> str:
    counts = _list(f"CAST(len(list_filter(lw, lambda x: x = {_quoted(k)})) AS DOUBLE)" for k in Q.COMMON)
    classes = _list(f"CAST(length(regexp_replace(t, {_quoted(others)}, '', 'g')) AS DOUBLE)" for others in Q.CLASSES.values())
    bad = f"(n_words < {Q.LEAST_WORDS} OR 100 * n_repeat_words > {Q.MOST_REPEATED} * n_words)"
    mean = lambda c: _list(f"avg({c}[{i + 1}])" for i in range(Q.SIZES[c]))
    every = lambda c: _list(f"sum({c}[{i + 1}] * documents) / sum(documents)" for i in range(Q.SIZES[c]))
    # A language's reference: its own mean and the mean of all, weighted.
    blended = lambda c: (
        f"coalesce(list_transform(list_zip(o.{c}, a.{c}), lambda z: (z[1] * o.documents + z[2] * {Q.SHARED_DOCUMENTS}) / (o.documents + {Q.SHARED_DOCUMENTS})), a.{c})")
    distance = lambda c: (
        f"sqrt(greatest(0.0, list_sum(list_transform(list_zip(f.{c}, {blended(c)}), lambda z: "
        "(CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2))))")
    near = (f"((n_words < {Q.GUARDS['characters']} OR character_distance <= {Q.CHARACTER_DISTANCE} + {Q.SLACK} / sqrt(greatest(n_words, 1))) "
            f"AND (n_words < {Q.GUARDS['common']} OR word_distance <= {Q.WORD_DISTANCE} + {Q.SLACK} / sqrt(greatest(n_words, 1))))")

    def compared(rows: str, known: str) -> str:
        return (f"SELECT f.*, {distance('characters')} AS character_distance, {distance('common')} AS word_distance FROM {rows} f "
                f"LEFT JOIN (SELECT * FROM {known} WHERE lang IS NOT NULL) o ON f.lang = o.lang, "
                f"(SELECT {every('characters')} AS characters, {every('common')} AS common FROM {known}) a")

    def means(rows: str) -> str:
        return f"SELECT lang, count(*) AS documents, {mean('characters')} AS characters, {mean('common')} AS common FROM {rows} GROUP BY lang"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) x WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) x GROUP BY r),
m AS (SELECT d.r, doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, list_transform(w, lambda x: lower(x)) AS lw FROM d LEFT JOIN covered USING (r)),
s AS (SELECT *, {classes} AS named, {counts} AS found, CAST(length(t) AS DOUBLE) AS chars FROM m),
f AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  list_transform(list_concat(named, [chars - word_chars, word_chars - list_sum(named)]), lambda x: CASE WHEN chars = 0 THEN 0 ELSE x / chars END) AS characters,
  list_transform(list_concat(found, [n_words - list_sum(found)]), lambda x: CASE WHEN n_words = 0 THEN 0 ELSE x / n_words END) AS common FROM s),
good AS (SELECT * FROM f WHERE NOT {bad} AND n_words >= {max(Q.GUARDS.values())}),
k1 AS ({means('good')}), c1 AS ({compared('good', 'k1')}), n1 AS (SELECT * FROM c1 WHERE {near}), k2 AS ({means('n1')}), c2 AS ({compared('f', 'k2')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {bad} AS base_failed,
  NOT {bad} AND {near} AS kept FROM c2"""


def license_scan() -> str:
    words = lambda text: (
        f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    templates = ", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(L.TEMPLATES))
    after = (f"word = {_quoted(word)} AND prior IN ({', '.join(map(_quoted, near))})" for word, near in L.TELLING_AFTER)
    before = (f"word = {_quoted(word)} AND later IN ({', '.join(map(_quoted, near))})" for word, near in L.TELLING_BEFORE)
    telling, naming = "(" + " OR ".join([*after, *before]) + ")", ", ".join(map(_quoted, L.NAMING))
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(L.GRAM))
    places = " UNION ALL ".join(
        f"SELECT r, i - 1 AS start, {_quoted(label)} AS label FROM p WHERE " + " AND ".join(f"w[i + {k}] = {_quoted(word)}" for k, word in enumerate(phrase))
        for phrase, label in L.PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
base AS ({places}),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_distinct(list(label)) AS found FROM base GROUP BY r),
t AS (SELECT template, label, {words('text')} AS w FROM (VALUES {templates}) v(template, label, text)),
tg AS (SELECT template, label, i - 1 AS spot, len(w) - {L.GRAM - 1} AS n_grams, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) - {L.GRAM - 2})) AS i FROM t) x),
said AS (SELECT 'd' AS kind, r, i - 1 AS pos, w[i] AS word, coalesce(w[i - 1], '') AS prior, coalesce(w[i + 1], '') AS later FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) x
  UNION ALL SELECT 't', template, i - 1, w[i], coalesce(w[i - 1], ''), coalesce(w[i + 1], '') FROM (SELECT template, w, unnest(range(1, len(w) + 1)) AS i FROM t) x),
marks AS (SELECT kind, r, pos, word, {telling} AS telling, word IN ({naming}) AS naming FROM said WHERE {telling} OR word IN ({naming})),
tm AS (SELECT r AS template, coalesce(list_sort(list_distinct(list(word) FILTER (telling))), []) AS telling, coalesce(list_distinct(list(word) FILTER (naming AND short)), []) AS naming
  FROM marks JOIN (SELECT template AS r, len(w) < {L.SHORT_WORDS} AS short FROM t) USING (r) WHERE kind = 't' GROUP BY r),
dg AS (SELECT r, i - 1 AS place, {gram} AS g FROM (SELECT r, w, unnest(range(1, len(w) - {L.GRAM - 2})) AS i FROM d) x),
diagonals AS (SELECT r, template, label, n_grams, place - spot AS diagonal, count(*) AS votes, min(spot) AS low, max(spot) AS high, min(place) AS first, max(place) AS last FROM dg JOIN tg USING (g) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {L.MERGE} THEN 0 ELSE 1 END AS apart FROM diagonals),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS grp FROM marked),
spans AS (SELECT r, template, label, grp, least(sum(votes), max(high) - min(low) + 1) / CAST(n_grams AS DOUBLE) AS share,
  min(first) - least(min(low), {L.MERGE}) AS begin, max(last) + {L.GRAM - 1} + least(n_grams - 1 - max(high), {L.MERGE}) AS finish FROM grouped GROUP BY r, template, label, n_grams, grp),
inside AS (SELECT s.r, s.template, s.label, s.grp, s.share, coalesce(list_sort(list_distinct(list(m.word) FILTER (m.telling))), []) AS telling,
  coalesce(list_distinct(list(m.word) FILTER (m.naming)), []) AS naming FROM spans s
  LEFT JOIN marks m ON m.kind = 'd' AND m.r = s.r AND m.pos BETWEEN s.begin AND s.finish WHERE s.share >= {L.COVER} GROUP BY ALL),
v AS (SELECT i.r, max(i.share) AS share, list(DISTINCT i.label) AS found FROM inside i LEFT JOIN tm USING (template)
  WHERE i.telling = coalesce(tm.telling, []) AND list_has_all(i.naming, coalesce(tm.naming, [])) GROUP BY i.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.found), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(v.found, [])))), ','), '') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN v USING (r)"""


def filter_audit() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(A.FILTERS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, [len(w) < {A.LEAST_WORDS}, 100 * len(list_distinct(w)) < {A.LEAST_DISTINCT} * len(w),
  100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {A.MOST_UPPER} * length(t), regexp_matches(t, '{A.SYMBOLS}'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
s AS (SELECT o AS filter_order, CAST(step AS INT) AS step, substr(o, step, 1) AS filter, list_transform(string_split(substr(o, 1, step - 1), ''), lambda x: ascii(x) - 64) AS before,
  ascii(substr(o, step, 1)) - 64 AS own FROM (VALUES {orders}) v(o), range(1, {len(A.FILTERS)} + 1) r(step)),
x AS (SELECT part, filter_order, step, filter, n, good, bad, fails[own] AS failed, len(list_filter(before, lambda i: i > 0 AND fails[i])) > 0 AS gone,
  len(list_filter(fails, lambda f: f)) = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (failed AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (failed AND alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(bad) FILTER (failed AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""


def fill_in_middle() -> str:
    """The units are listed by a pattern and the cuts are sums of their lengths."""
    h = lambda i: f"CAST(concat('0x', substr(d, {8 * i + 1}, 8)) AS BIGINT)"
    chars = lambda k: f"CAST(coalesce(list_sum(list_transform(u[1:{k}], lambda x: length(x))), 0) AS BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT *, len(u) AS n, {h(0)} % (len(u) + 1) AS a, {h(1)} % (len(u) + 1) AS b, {h(2)} % 100 AS c, {h(3)} % 100 AS e FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form,
  {chars('least(a, b)')} AS p, {chars('greatest(a, b)')} AS q FROM h),
o AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o"""
