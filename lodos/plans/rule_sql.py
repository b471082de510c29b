"""SQL for DuckDB that answers like the queries on rules: informal words, worn phrases, style, morphology, grammar."""

from __future__ import annotations

from ..functions import letters as L
from ..operators import grammar as G
from ..operators import morphology as M
from ..operators import spelling as S
from ..operators import style as Y
from .letter_queries import sql_lower, sql_title, sql_upper, sql_vowels
from .token_queries import _SENT, PATTERN, _kind, sql_rows

_SPACE = r"[\s\x{a0}\x{85}\x{2000}-\x{200a}\x{3000}\x0b]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:  # noqa: ANN001
    return "(" + ", ".join(map(_q, words)) + ")"


def _map(pairs: dict[str, str], key: str) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in pairs.items()) + " END)"


def _cased(like: str, text: str) -> str:
    return f"(CASE WHEN regexp_matches({like}, '^\\p{{Lu}}') THEN {sql_title(text)} ELSE {text} END)"


def _last_vowel(x: str) -> str:
    return f"nullif({sql_vowels(x)}[-1:], '')"


def _close(x: str) -> str:
    """m and the close vowel that harmony asks for behind a word; null without a vowel."""
    v = _last_vowel(x)
    return f"(CASE WHEN {v} IS NULL THEN NULL WHEN regexp_matches({v}, '[öüÖÜ]') THEN 'mü' WHEN regexp_matches({v}, '[{L.FRONT}]') THEN 'mi' WHEN regexp_matches({v}, '[{L.ROUNDED}]') THEN 'mu' ELSE 'mı' END)"


# --- words


def informal_words() -> str:
    chars = "string_split(p, '')"
    short = f"array_to_string(list_filter({chars}, lambda c, i: i <= 2 OR c <> {chars}[i - 1] OR c <> {chars}[i - 2]), '')"
    found = f"coalesce({_map(S.FREQUENT, sql_lower('p'))}, {_map(S.FREQUENT, 'lower(p)')})"
    cased = f"CASE WHEN regexp_matches(p, '^\\p{{Lu}}{{2,}}$') THEN {sql_upper(found)} WHEN regexp_matches(p, '^\\p{{Lu}}') THEN {sql_title(found)} ELSE {found} END"
    each = {"short": short, "informal": f"coalesce({_map(S.SHORT, sql_lower(short))}, {short})", "restored": f"coalesce({cased}, p)"}
    cols = ", ".join(f"md5(string_agg({name}, '' ORDER BY k)) AS {name}_md5" for name in each)
    forms = ", ".join(f"CASE WHEN regexp_matches(p, '^\\p{{L}}') THEN {x} ELSE p END AS {name}" for name, x in each.items())
    parts = r"regexp_extract_all(text, '\p{L}+|\P{L}+')"
    return f"""WITH p AS (SELECT doc_id, unnest({parts}) AS p, unnest(range(len({parts}))) AS k FROM documents),
    forms AS (SELECT p, {forms} FROM (SELECT DISTINCT p FROM p))
    SELECT doc_id, {cols} FROM p JOIN forms USING (p) GROUP BY doc_id
    UNION ALL SELECT doc_id, md5(''), md5(''), md5('') FROM documents WHERE text = ''"""


# --- style


def _phrase_count(phrase: str) -> str:
    """Occurrences with no letter on either side: a part between two is empty where they touch."""
    parts = f"string_split(low, {_q(phrase)})"
    before = f"((i = 1 AND {parts}[i] = '') OR regexp_matches({parts}[i], '\\P{{L}}$'))"
    after = f"((i = len({parts}) - 1 AND {parts}[i + 1] = '') OR regexp_matches({parts}[i + 1], '^\\P{{L}}'))"
    return f"CASE WHEN contains(low, {_q(phrase)}) THEN len(list_filter(range(1, len({parts})), lambda i: {before} AND {after})) ELSE 0 END"


def _pattern_count(category: str, literals: tuple[str, ...], pattern: str) -> str:
    over = "text" if category == "SemicolonConjunction" else "low"
    edge = r"(?:^|[^\p{L}\p{N}_])"
    re2 = pattern.replace(r"\s", _SPACE)
    re2 = (edge + re2[2:] if re2.startswith(r"\b") else re2).removesuffix(r"\b")
    holds = " OR ".join(f"contains({over}, {_q(x)})" for x in literals)
    return f"CASE WHEN {holds} THEN len(regexp_extract_all({over}, {_q(re2)})) ELSE 0 END"


def _categories() -> str:
    sums: dict[str, list[str]] = {c: [] for c in Y.PENALTY}
    for c, ps in Y.PHRASES.items():
        sums[c] += map(_phrase_count, ps)
    for c, literals, pattern in Y.PATTERNS:
        sums[c].append(_pattern_count(c, literals, pattern))
    return ", ".join(f"({' + '.join(x)})::BIGINT AS {c}" for c, x in sums.items())


def cliche_hits() -> str:
    return f"SELECT doc_id, {_categories()} FROM (SELECT doc_id, text, {sql_lower('text')} AS low FROM documents)"


def style_audit() -> str:
    score = " + ".join(f"{c} * {p}" for c, p in Y.PENALTY.items())
    formal = "(mektedir|maktadır|mektedirler|maktadırlar)$"
    verdict = "CASE " + " ".join(f"WHEN score >= {b} THEN {_q(v)}" if b is not None else f"ELSE {_q(v)}" for b, v in Y.VERDICTS) + " END"
    return f"""WITH {sql_rows('documents', 'doc_id')},{_SENT.format(key='doc_id')},
    c AS ({cliche_hits()}),
    m AS (SELECT doc_id, (length(text) - length(replace(text, '—', '')) + (length(text) - length(replace(text, ' -- ', ''))) // 4)::BIGINT AS em_dashes, (length(text) - length(replace(text, ';', '')))::BIGINT AS semicolons,
      CASE WHEN len(t) > 2 THEN len(list_filter(t[2:-2], lambda w: w = ':')) ELSE 0 END AS inline_colons FROM (SELECT doc_id, text, regexp_extract_all(text, '{PATTERN}') AS t FROM documents)),
    n AS (SELECT doc_id, sentence, count(*) FILTER ({_kind('t')} NOT IN ('Punctuation', 'Symbol')) AS n,
      arg_max({sql_lower('t')}, pos) FILTER (regexp_matches(t, '^\\p{{L}}+(?:[''’]\\p{{L}}+)*$')) AS last FROM sent GROUP BY ALL),
    r AS (SELECT doc_id, count(*) AS sentences, count(*) FILTER (n < 5) AS short, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS deviation, count(*) FILTER (regexp_matches(last, '{formal}')) AS formal FROM n GROUP BY doc_id),
    a AS (SELECT c.doc_id, coalesce(sentences, 0) AS sentences, coalesce(formal, 0) AS predicates, coalesce(formal, 0) AS mektedir,
      ({score})::DOUBLE + em_dashes * 15 + CASE WHEN semicolons >= 2 THEN semicolons * 8 ELSE 0 END + CASE WHEN inline_colons >= 2 THEN inline_colons * 8 ELSE 0 END
      + CASE WHEN sentences >= 3 AND mean >= 16 AND deviation / mean < 0.30 THEN 20 ELSE 0 END + CASE WHEN sentences >= 3 AND short = 0 AND round(mean, 1) > 15 THEN 10 ELSE 0 END
      + CASE WHEN formal >= 2 THEN 25 ELSE 0 END AS raw FROM c JOIN m USING (doc_id) LEFT JOIN r USING (doc_id)),
    s AS (SELECT *, least(greatest(raw, 0.0), 100.0)::DOUBLE AS score FROM a)
    SELECT doc_id, sentences, predicates, mektedir, score, {verdict} AS verdict FROM s"""


# --- morphology


def lexicon_values() -> str:
    rows = []
    for i, line in enumerate(M.SEED.strip().split("\n")):
        lemma, root, pos, *more = line.split()
        flags = [M.ATTRS[m.lower()] for m in more if m.lower() in M.ATTRS]
        second = "ProperNoun" if "Prop" in more else "Time" if "Time" in more else "None"
        rows.append(f"({_q(lemma)}, {_q(root)}, {_q(pos)}, {_q(second)}, [{', '.join(map(_q, flags))}]::VARCHAR[], {i})")
    return f"(VALUES {', '.join(rows)}) AS lex(lemma, root, pos, secondary, attrs, ord)"


def lexicon_entries() -> str:
    return f"SELECT lemma, root, pos, secondary, array_to_string(attrs, ',') AS attrs, ord::BIGINT AS ord FROM {lexicon_values()}"


def generated_forms() -> str:
    """One suffix behind each root."""
    opens = "tag IN ('P1sg', 'P2sg', 'P3sg', 'Dat', 'Acc', 'Gen')"
    soft = lambda x: f"CASE WHEN list_contains(attrs, 'Voicing') THEN {x}[:-2] || CASE WHEN {x}[-2:] = 'nk' THEN 'g' ELSE translate({x}[-1:], 'pçtk', 'bcdğ') END ELSE {x} END"
    dropped = "regexp_replace(root, '[ıiuü](.)$', '\\1')"
    drops = "list_contains(attrs, 'VowelDrop') AND regexp_matches(root, '.[ıiuü].$')"
    stem = f"CASE WHEN NOT {opens} THEN root WHEN {drops} THEN {soft(dropped)} WHEN list_contains(attrs, 'Doubling') THEN root || root[-1:] ELSE {soft('root')} END"
    open_ = f"CASE WHEN list_contains(attrs, 'InverseHarmony') OR {_last_vowel('s')} IS NULL OR regexp_matches({_last_vowel('s')}, '[{L.FRONT}]') THEN 'e' ELSE 'a' END"
    close = f"CASE WHEN list_contains(attrs, 'InverseHarmony') THEN 'i' ELSE coalesce({_close('s')}[2:], 'i') END"
    past = f"coalesce({_close('s')}[2:], 'i')"
    forms = {
        "A3pl": "s || 'l' || a || 'r'", "P1sg": "s || CASE WHEN v THEN '' ELSE i END || 'm'", "P2sg": "s || CASE WHEN v THEN '' ELSE i END || 'n'", "P3sg": "s || CASE WHEN v THEN 's' ELSE '' END || i",
        "Dat": "s || CASE WHEN v THEN 'y' ELSE '' END || a", "Acc": "s || CASE WHEN v THEN 'y' ELSE '' END || i", "Loc": "s || d || a", "Abl": "s || d || a || 'n'", "Gen": "s || CASE WHEN v THEN 'n' ELSE '' END || i || 'n'",
        "Past": "s || d || p",
    }
    made = "CASE tag " + " ".join(f"WHEN '{t}' THEN {x}" for t, x in forms.items()) + " END"
    return f"""WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ord) AS r FROM {lexicon_values()}) WHERE r = 1),
    asked AS (SELECT root, attrs, unnest([{', '.join(map(_q, forms))}]) AS tag FROM first),
    stems AS (SELECT root, tag, attrs, {stem} AS s FROM asked),
    sounds AS (SELECT *, {open_} AS a, {close} AS i, {past} AS p, regexp_matches(s, '[{L.VOWELS}]$') AS v, CASE WHEN regexp_matches(s, '[{L.HARD}]$') THEN 't' ELSE 'd' END AS d FROM stems)
    SELECT root AS lemma, tag, {made} AS surface FROM sounds"""


def parse_ctes(words: str) -> str:
    """CTEs up to ``parsed`` (word, lemma, root, pos, secondary, tags, score, formatted, rank) of the lower-case words of a query (word)."""
    edges = ", ".join(f"({_q(a)}, {_q(s)}, {_q(tag)}, {_q(to)})" for a, es in M.graph().items() for s, tag, to in es)
    vowel = f"[{L.VOWELS}]"
    two = f"regexp_matches(stem, '[^{L.VOWELS}][^{L.VOWELS}]$')"
    ways = ["SELECT word, suffix, stem AS try, NULL AS need FROM cuts", "SELECT word, suffix, stem || 'k', NULL FROM cuts"]
    ways += [f"SELECT word, suffix, stem[:-2] || '{b}', 'Voicing' FROM cuts WHERE stem[-1:] = '{a}'" for a, b in ("bp", "cç", "dt", "ğk", "gk")]
    ways += [f"SELECT word, suffix, stem[:-2] || '{v}' || stem[-1:], 'VowelDrop' FROM cuts WHERE {two}" for v in "ıiuü"]
    ways.append(f"SELECT word, suffix, stem[:-2], 'Doubling' FROM cuts WHERE {two} AND length(stem) >= 3 AND stem[-1:] = stem[-2:-2]")
    default = " ".join(f"WHEN '{k}' THEN [{', '.join(map(_q, v))}]" for k, v in M.DEFAULT_TAGS.items())
    shown = "'[' || lemma || ':' || pos || '] ' || root || ':' || array_to_string(tags, '+')"
    del vowel
    return f"""base AS (SELECT DISTINCT word FROM ({words})),
    lexicon AS (SELECT * FROM {lexicon_values()}),
    edges(state, suffix, tag, next) AS (VALUES {edges}),
    cuts AS (SELECT word, word[:k] AS stem, word[k + 1:] AS suffix FROM (SELECT word, unnest(range(1, length(word))) AS k FROM base)),
    tried AS ({' UNION ALL '.join(ways)}),
    met AS (SELECT word, suffix, lemma, root, pos, secondary, CASE WHEN pos = 'Verb' THEN 'V' ELSE 'N' END AS state FROM tried JOIN lexicon ON root = try WHERE need IS NULL OR list_contains(attrs, need)),
    walk AS (SELECT DISTINCT state AS s0, suffix AS x0, state, suffix AS rest, []::VARCHAR[] AS tags FROM met
      UNION ALL SELECT w.s0, w.x0, e.next, w.rest[length(e.suffix) + 1:], list_append(w.tags, e.tag) FROM walk w JOIN edges e ON e.state = w.state AND starts_with(w.rest, e.suffix) WHERE len(w.tags) < {M.DEPTH}),
    every AS (SELECT word, lemma, root, pos, secondary, CASE pos {default} ELSE [pos] END AS tags, 1.0::DOUBLE AS score FROM base JOIN lexicon ON root = word
      UNION ALL SELECT word, lemma, root, pos, secondary, list_prepend(pos, w.tags), CASE WHEN secondary = 'ProperNoun' THEN 0.6 ELSE 0.95 END FROM met JOIN walk w ON w.s0 = met.state AND w.x0 = met.suffix AND w.rest = ''),
    told AS (SELECT *, {shown} AS formatted, row_number() OVER (PARTITION BY word, score, {shown}) AS copy FROM every),
    parsed AS (SELECT * EXCLUDE (copy), row_number() OVER (PARTITION BY word ORDER BY score DESC, formatted) AS rank FROM told WHERE copy = 1)"""


def _document_words() -> str:
    return f"SELECT DISTINCT {sql_lower('t')} AS word FROM (SELECT unnest(regexp_extract_all(text, '{PATTERN}')) AS t FROM documents) WHERE regexp_matches(t, '^\\p{{L}}+$')"


def morph_analysis() -> str:
    return f"WITH RECURSIVE {parse_ctes(_document_words())} SELECT word, rank, formatted, score FROM parsed"


def word_stems() -> str:
    return f"""WITH RECURSIVE {parse_ctes(_document_words())}
    SELECT b.word, coalesce(root, b.word) AS stem, coalesce(list_has_any(tags, [{', '.join(map(_q, sorted(M.VERBAL)))}]), false) AS verbal, coalesce(secondary = 'ProperNoun' OR pos = 'Num', false) AS known
    FROM base b LEFT JOIN parsed p ON p.word = b.word AND p.rank = 1"""


def compound_words() -> str:
    halves = f"SELECT word AS whole, place, word[:place] AS a, word[place + 1:] AS b FROM (SELECT word, unnest(range(2, length(word) - 1)) AS place FROM ({_document_words()}))"
    return f"""WITH RECURSIVE halves AS ({halves}), {parse_ctes('SELECT a AS word FROM halves UNION SELECT b FROM halves')},
    best AS (SELECT word, formatted FROM parsed WHERE rank = 1)
    SELECT whole AS word, place::INT AS "at", x.formatted AS first, y.formatted AS second FROM halves JOIN best x ON x.word = a JOIN best y ON y.word = b"""


# --- grammar


def _finding_ctes() -> str:
    """CTEs up to ``found`` (doc_id, start, end, ord, category, original, replacement), without rules on parses."""
    text = f"regexp_extract_all(text, '{PATTERN}')"
    pair, both = "plow || ' ' || low", "prev || ' ' || tok"
    own, stem = "word[-2:]", "word[:-3]"
    particles = _in(("mi", "mı", "mu", "mü"))
    persons = "|".join(sorted(G.QUESTION, key=len, reverse=True))
    person = f"regexp_extract(word, '^(?s:.*?)({persons})$', 1)"
    root = lambda roots, k: f"regexp_extract(low, '^({'|'.join(roots)})([{L.VOWELS}].*)$', {k})"
    rooted = lambda roots: f"CASE WHEN {root(roots, 1)} <> '' THEN {_map(roots, root(roots, 1))} || {root(roots, 2)} END"
    narrow = "CASE " + " ".join(f"WHEN ends_with(low, {_q(a)}) THEN low[:length(low) - {len(a)}] || {_q(b)}" for a, b in G.NARROWED.items()) + " END"
    front = f"({_last_vowel('plow')} IS NULL OR regexp_matches({_last_vowel('plow')}, '[{L.FRONT}]'))"
    sounds = [("VowelDropping", _cased("tok", rooted(G.DROPPED))), ("VowelHarmony", _cased("tok", narrow)), ("VowelDropping", _cased("tok", _map(G.SPOKEN, "low"))), ("ConsonantSoftening", _cased("tok", rooted(G.SOFTENED)))]
    rules = [
        (10, "s", "Capitalization", "tok", f"CASE WHEN pos = 0 AND regexp_matches(tok, '^\\p{{Ll}}') THEN {sql_title('tok')} END"),
        (20, "s", "ParticleMi", "tok", f"CASE WHEN {own} IN {particles} AND length(word) > 2 AND strlen({stem}) > 2 AND {own} = {_close(stem)} AND regexp_matches({stem}, '[rnkzdtmşl]$') THEN bare[:-3] || ' ' || {own} || marks END"),
        (21, "s", "ParticleMi", "tok", f"CASE WHEN {person} <> '' AND strlen(word) - strlen({person}) > 2 THEN bare[:length(bare) - length({person})] || ' ' || {person} || marks END"),
        (22, "s", "ParticleMi", "tok", f"CASE WHEN word IN {particles} AND word <> {_close('plow')} THEN {_close('plow')} || marks END"),
        (30, "s", "CliticDeDa", "tok", f"CASE WHEN low IN ('te', 'ta') AND prev IS NOT NULL THEN CASE WHEN {front} THEN 'de' ELSE 'da' END END"),
        (31, "s", "CliticDeDa", "tok", _cased("tok", _map(G.WITH_DE, "low"))),
        (32, "ps", "CliticDeDa", both, f"CASE WHEN low IN ('da', 'de', 'dan', 'den', 'nda', 'nde') AND plow IN {_in(G.LOCATIVE)} THEN prev || tok END"),
        (40, "ps", "CliticKi", both, f"CASE WHEN low = 'ki' AND plow || 'ki' IN {_in(G.WITH_KI_ATTACHED)} THEN {_cased('prev', "(plow || 'ki')")} END"),
        (41, "s", "CliticKi", "tok", _cased("tok", _map(G.WITH_KI, "low"))),
        (60, "s", "ReduplicationOrthography", "tok", _map(G.DOUBLES, "low")),
        (70, "ps", "CompoundWordOrthography", both, f"CASE WHEN regexp_matches(low, '^({'|'.join(G.BIL)})') AND regexp_matches(plow, '[ae]$') AND strlen(plow) >= 3 THEN prev || tok END"),
        (80, "ps", "CompoundWordOrthography", both, _cased("prev", _map(G.INDEFINITE, f"({pair})"))),
        *[(90, "s", c, "tok", f"CASE WHEN regexp_matches(low, '\\p{{L}}')" + "".join(f" AND ({x}) IS NULL" for _, x in sounds[:i]) + f" THEN {x} END") for i, (c, x) in enumerate(sounds)],
        (110, "s", "CompoundWordOrthography", "tok", _cased("tok", _map(G.APART, "low"))),
        (111, "ps", "CompoundWordOrthography", both, _map(G.TOGETHER, f"({pair})")),
    ]
    tokens = " UNION ALL ".join(f"SELECT doc_id, {s} AS start, e AS \"end\", {o} AS ord, '{c}' AS category, {was} AS original, {better} AS replacement FROM words" for o, s, c, was, better in rules)
    marks = []
    for i, mark in enumerate(G.ORDINAL):
        at = f"instr(text, {_q(mark)})"
        number = f"regexp_extract(text[:{at} - 1], '(?s)([0-9]+)$', 1)"
        marks.append(f"SELECT doc_id, {at} - 1 - length({number}) AS start, {at} - 1 + {len(mark)} AS \"end\", {50 + i} AS ord, 'ApostropheNumberDate' AS category, {number} || {_q(mark)} AS original, CASE WHEN {at} > 0 AND {number} <> '' THEN {number} || {_q(mark[1:])} END AS replacement FROM documents")
    for i, (phrase, better) in enumerate(G.TWICE.items()):
        at = f"instr({sql_lower('text')}, {_q(phrase)})"
        marks.append(f"SELECT doc_id, {at} - 1, {at} - 1 + {len(phrase)}, {120 + i}, 'TautologyRedundancy', text[{at}:{at} + {len(phrase) - 1}], CASE WHEN {at} > 0 THEN {_q(better)} END FROM documents")
    part = "'[^" + _SPACE[1:-1] + ".,(\"!]+'"
    number, derived = "regexp_matches(root, '^[0-9]+$')", f"(regexp_matches({sql_lower('root')}, '{G._DERIVED_ROOT}') OR regexp_matches({sql_lower('suffix')}, '{G._DERIVED_SUFFIX}'))"
    low = sql_lower("suffix")
    return f"""r AS (SELECT doc_id, unnest({text}) AS tok, unnest(string_split_regex(text, '{PATTERN}')[1:len({text})]) AS gap, unnest(range(len({text}))) AS pos FROM documents),
    ends AS (SELECT *, sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS e, {sql_lower('tok')} AS low FROM r),
    near AS (SELECT doc_id, pos, tok, low, e, e - length(tok) AS s, lag(tok) OVER w AS prev, lag(low) OVER w AS plow, lag(e - length(tok)) OVER w AS ps, regexp_replace(tok, '[!-/:-@\\[-`{{-~]+$', '') AS bare FROM ends WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    words AS (SELECT *, tok[length(bare) + 1:] AS marks, {sql_lower('bare')} AS word FROM near),
    parts AS (SELECT doc_id, unnest(regexp_extract_all(text, {part})) AS part, unnest(string_split_regex(text, {part})[1:len(regexp_extract_all(text, {part}))]) AS gap, unnest(range(len(regexp_extract_all(text, {part})))) AS pos FROM documents),
    begun AS (SELECT *, sum(length(gap) + length(part)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT - length(part) AS start FROM parts),
    quoted AS (SELECT doc_id, start, part, unnest(list_filter(range(1, length(part) + 1), lambda i: part[i:i] = '''')) AS place FROM begun WHERE contains(part, '''')),
    cut AS (SELECT doc_id, start, part[:place - 1] AS root, regexp_extract(part[place + 1:], '^\\p{{L}}+') AS suffix FROM quoted),
    apart AS (SELECT *, CASE WHEN {number} AND regexp_matches(root, '[345]$') AND regexp_matches({low}, '^d[ea]') THEN root || '''t' || {low}[2:2] || suffix[3:] END AS hard,
      CASE WHEN NOT {number} AND {derived} THEN root || suffix END AS joined FROM cut WHERE root <> '' AND suffix <> ''),
    every AS ({tokens} UNION ALL {' UNION ALL '.join(marks)}
      UNION ALL SELECT doc_id, start, start + length(root) + 1 + length(suffix), 58, CASE WHEN hard IS NOT NULL THEN 'ApostropheNumberDate' ELSE 'ApostropheProperNoun' END, root || '''' || suffix, coalesce(hard, joined) FROM apart),
    told AS (SELECT *, lag(start) OVER w AS bs, lag("end") OVER w AS be FROM every WHERE replacement IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY start, ord, "end", category, original, replacement)),
    found AS (SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", ord, category, original, replacement FROM told WHERE bs IS NULL OR bs <> start OR be <> "end")"""


def grammar_findings() -> str:
    return f'WITH {_finding_ctes()} SELECT doc_id, start, "end", category, original, replacement FROM found'


def corrected_text() -> str:
    return f"""WITH RECURSIVE {_finding_ctes()},
    turn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC, ord DESC, "end" DESC, category DESC, original DESC, replacement DESC) AS k FROM found),
    spliced AS (SELECT doc_id, text AS t, 0::BIGINT AS k FROM documents
      UNION ALL SELECT s.doc_id, s.t[:f.start] || f.replacement || s.t[f."end" + 1:], f.k FROM spliced s JOIN turn f ON f.doc_id = s.doc_id AND f.k = s.k + 1)
    SELECT doc_id, max(k) AS n_findings, arg_max(t, k) AS corrected FROM spliced GROUP BY doc_id"""
