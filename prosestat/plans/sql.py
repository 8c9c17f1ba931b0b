"""The same definitions in DuckDB SQL, written without lookaround, for side-by-side checks."""

from __future__ import annotations

from ..functions import lexicons as lex
from ..functions import text as tx
from . import fixtures

WORD = r"\[[A-Z]+\]|[A-Za-z]+(?:''[A-Za-z]+)?"
CUT, ITEM, DOT = "chr(3)", "chr(1)", "chr(2)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(terms) -> str:
    return "[" + ", ".join(map(q, terms)) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    return f"translate({x}, '’‘ʼ' || chr(146), '''''''''')"


def words(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '{WORD}')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def has_word(x: str) -> str:
    return rf"regexp_matches({x}, '\[[A-Z]+\]|[A-Za-z]')"


def lines(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '\n$', ''), chr(10))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {pattern}))"


def phrase_count(x: str, term: str) -> str:
    r"""Letter-bounded, non-overlapping: every sign that is no letter is doubled, so that two
    neighbours each find a bound of their own."""
    doubled = rf"regexp_replace({x}, '([^A-Za-z])', '\1\1', 'g')"
    pattern = "".join(c if c.isalpha() else ("\\" + c if not c.isspace() else c) * 2 for c in term).replace("'", "''")
    return f"len(regexp_extract_all({doubled}, '(?i)(?:^|[^A-Za-z]){pattern}(?:[^A-Za-z]|$)'))"


def each(source: str, var: str, body: str) -> str:
    return f"list_transform({source}, lambda {var}: {body})"


def keep(source: str, var: str, test: str) -> str:
    return f"list_filter({source}, lambda {var}: {test})"


def held(source: str, var: str, test: str) -> str:
    return f"len({keep(source, var, test)})"


def sentences(x: str) -> str:
    t = x
    for a in sorted(lex.ABBREVIATIONS, key=len, reverse=True):
        runs = [r for r in a.split(".") if r]
        into = " || chr(2) || ".join(f"'\\{k + 1}'" for k in range(len(runs))) + " || chr(2)"
        t = f"regexp_replace({t}, '(?i)" + r"\.".join(f"({r})" for r in runs) + rf"\.', {into}, 'g')"
    for _ in range(2):  # 1.2.3 overlaps
        t = rf"regexp_replace({t}, '(\d)\.(\d)', '\1' || chr(2) || '\2', 'g')"
    t = rf"regexp_replace({t}, '[ \t]*\n[ \t]*', chr(10), 'g')"
    t = rf"regexp_replace({strip(t)}, '\n{{2,}}', chr(3), 'g')"
    t = rf"regexp_replace({t}, '(^|\n|\x03)(?:[-*+] |\d+\. )([^\n\x03]*)', chr(3) || chr(1) || '\2' || chr(3), 'g')"
    t = rf"regexp_replace({t}, '\n?\x03\n?', chr(3), 'g')"
    t = rf"regexp_replace({t}, '([.!?])\n', '\1' || chr(3), 'g')"
    t = rf"regexp_replace({t}, '\n([A-Z])', chr(3) || '\1', 'g')"
    t = f"replace({t}, chr(10), ' ')"
    piece = r"CASE WHEN starts_with(p, chr(1)) THEN [substr(p, 2)] ELSE string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(3), 'g'), chr(3)) END"
    parts = each(f"string_split({t}, chr(3))", "p", piece)
    return keep(each(f"flatten({parts})", "s", "replace(s, chr(2), '.')"), "s", has_word("s"))


def records() -> str:
    """CTEs docs, rec, tpl (with template) and usable."""
    return rf"""WITH docs AS (SELECT doc_id, text, lang, source, n_chars FROM documents UNION ALL SELECT * FROM {fixtures.sql_values()}),
rec AS (SELECT substr(sha256(d.doc_id::VARCHAR), 1, 16) AS record_id, d.doc_id, d.source, (TRY_CAST(regexp_extract(d.source, '(\d+)$', 1) AS INT) % 2 = 0) AS eligible,
  ({array(lex.CLASSES)})[(d.doc_id % 8 + 1)::INT] AS recipient_class, (['new', 'reply', 'forward'])[(d.doc_id % 3 + 1)::INT] AS thread_position,
  CASE WHEN d.doc_id % 50 <> 0 THEN (2015 + d.doc_id % 10)::INT END AS year, d.doc_id % 11 = 0 AS inline_reply, d.doc_id % 7 = 0 AS has_residual, d.text, {count("coalesce(d.text, '')", "'[A-Za-z]+(?:''[A-Za-z]+)?'")}::BIGINT AS word_count,
  CASE WHEN coalesce(l.low, false) THEN 'low' ELSE 'high' END AS confidence, coalesce(l.sensitive, false) AS sensitive
  FROM docs d LEFT JOIN (SELECT doc_id, min(quality) = 0 AS low, max(toxic) = 1 AS sensitive FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
tpl AS (SELECT * EXCLUDE (k), count(*) OVER (PARTITION BY k) >= 3 AS template, k FROM (SELECT *, lower({strip(r"regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')")}) AS k FROM rec)),
usable AS (SELECT * FROM tpl WHERE confidence <> 'low' AND (NOT template OR record_id IN (SELECT min(record_id) FROM tpl WHERE confidence <> 'low' AND template GROUP BY k)))"""


_CANON = r"lower(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '[,.!]+$', ''))"
_POLITE = r"(?i)^(?:Hi|Hey|Hello|Heya|Dear|Morning|Good (?:day|morning|afternoon|evening))\b\s*([^,\n]{1,40})?,"
_BARE = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}),"


def prepared(source: str, name: str = "prep") -> str:
    """CTEs up to ``name``: source with greeting, signoff and body."""
    canon = lambda x: _CANON.replace("{x}", x)
    return rf"""{name}_a AS (SELECT *, {lines(strip(norm("coalesce(text, '')")))} AS ls FROM {source}),
{name}_b AS (SELECT *, regexp_extract(ls[1], '{_POLITE}', 0) AS g0, regexp_extract(ls[1], '{_POLITE}', 1) AS g1, regexp_extract(ls[1], '{_BARE}', 0) AS b0,
  (list_filter(list_transform(ls[greatest(len(ls) - 5, 1):], lambda x: {canon("x")}), lambda x: list_contains({array(lex.VALEDICTIONS)}, x)))[-1] AS signoff FROM {name}_a),
{name}_c AS (SELECT * EXCLUDE (g0, g1, b0), CASE WHEN g0 <> '' THEN CASE WHEN trim(g1) <> '' AND NOT list_contains({array(lex.GROUPS)}, lower(trim(g1))) THEN substr(g0, 1, length(g0) - length(g1) - 1) || '[NAME],' ELSE g0 END
  WHEN b0 <> '' THEN CASE WHEN NOT list_contains({array(lex.GROUPS)}, lower(rtrim(b0, ','))) THEN '[NAME],' ELSE b0 END END AS greeting FROM {name}_b),
{name} AS (SELECT * EXCLUDE (ls), {strip(f"array_to_string(list_filter(CASE WHEN greeting IS NOT NULL THEN ls[2:] ELSE ls END, lambda x: signoff IS NULL OR {canon('x')} <> signoff), chr(10))")} AS body FROM {name}_c)"""


def rate(n: str, of: str, scale: int) -> str:
    return f"CASE WHEN {of} > 0 THEN ({n}) * {scale}.0 / {of} ELSE 0 END"


def measured(source: str, name: str = "met") -> str:
    """CTEs up to ``name``: source (with body) with a column for each metric, and gated."""
    syl = "greatest(1, len(regexp_extract_all(lower(t), '[aeiouy]+')) - CASE WHEN lower(t) LIKE '%e' AND NOT regexp_matches(lower(t), '[ly]e$') AND len(regexp_extract_all(lower(t), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"
    soft = " OR ".join(f"{phrase_count('s', p)} > 0" for p in lex.SOFTENERS)
    dash = r"regexp_replace(body, '([A-Za-z\[\]])', '\1\1', 'g')"
    rows = "list_transform(string_split(body, chr(10)), lambda x: " + strip("x") + ")"
    bold = r"^(?:\*\*\S(?:.*\S)?\*\*|__\S(?:.*\S)?__)$"
    values = {
        "words": "n",
        "sentence_len": rate("s", "n", 1).replace("(s) * 1.0 / n", "n * 1.0 / s").replace("WHEN n > 0", "WHEN s > 0"),
        "paragraph_len": rate("s", "p", 1),
        "paragraphs": "p",
        "contraction_rate": rate(held("low", "t", f"regexp_matches(t, '(?:n''t|''m|''re|''ve|''ll|''d)$') OR list_contains({array(lex.CONTRACTED)}, t)"), "n", 100),
        "question_softener_rate": rate(held("sents", "s", f"s LIKE '%?' AND ({soft})"), "s", 100),
        "question_rate": rate(held("sents", "s", "s LIKE '%?'"), "s", 100),
        "exclamation_rate": rate(held("sents", "s", "s LIKE '%!'"), "s", 100),
        "exclamations_per_email": count("body", "'!'"),
        "parenthetical_rate": rate(held(r"regexp_extract_all(body, '\([^()]*\)')", "x", has_word("x")), "s", 100),
        "ellipsis_rate": rate(count("body", r"'\.\.\.|…'"), "n", 1000),
        "spaced_dash_rate": rate(count(dash, r"'[A-Za-z\]] [–—-] [A-Za-z\[]'"), "n", 1000),
        "emoji_rate": f"{count('body', q(lex.emoji_class()))} + {count('body', q(':\\)|;\\)|:-\\)|:D'))}",
        "first_person_rate": rate(held("low", "t", "list_contains(['i', 'me', 'my', 'mine'], t)"), "n", 100),
        "second_person_rate": rate(held("low", "t", "list_contains(['you', 'your', 'yours'], t)"), "n", 100),
        "list_use": rf"(len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-*+] |\d+\. )'))) > 0)::INT",
        "heading_use": rf"(len(list_filter(range(1, len(hs) + 1), lambda i: regexp_matches(hs[i], '^#{{1,6}}[ \t]+') OR regexp_matches(hs[i], '{bold}') OR (coalesce(regexp_matches(hs[i + 1], '^(?:=+|-+)$'), false) AND {has_word('hs[i]')} AND NOT regexp_matches(hs[i], '^\s*(?:[-*+] |\d+\. )') AND NOT starts_with(hs[i], '>')))) > 0)::INT",
        "flesch_reading_ease": f"CASE WHEN n > 0 AND s > 0 THEN 206.835 - 1.015 * n / s - 84.6 * list_sum(list_transform(tok, lambda t: {syl})) / n ELSE 0 END",
        "greeting_share": "(greeting IS NOT NULL)::INT",
        "signoff_share": "(signoff IS NOT NULL)::INT",
    }
    columns = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in values.items())
    return rf"""{name}_a AS (SELECT *, {words("body")} AS tok, {sentences("body")} AS sents, {rows} AS hs, len(list_filter(string_split(regexp_replace(body, '\n\s*\n', chr(3), 'g'), chr(3)), lambda x: {has_word("x")})) AS p FROM {source}),
{name}_b AS (SELECT *, list_transform(tok, lambda t: lower(t)) AS low, len(tok) AS n, len(sents) AS s FROM {name}_a),
{name} AS (SELECT * EXCLUDE (tok, sents, hs, p, low, n, s), {columns}, n >= 80 AND s >= 5 AS gated FROM {name}_b)"""


#: Word characters as Java has them with (?U).
W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def run(source: str, first: str, step: str, last: str) -> str:
    """A walk over a list with a state: structs with the state's fields and x, an element."""
    return f"list_transform([list_reduce([{first}] || {source}, lambda a, e: {step})], lambda a: {last})[1]"


def staccato(lengths: str) -> str:
    state = lambda k, n, lo, hi, x: f"{{'k': {k}, 'n': {n}, 'lo': {lo}, 'hi': {hi}, 'last': {x}, 'x': 0}}"
    fits = "e.x <= 6 AND (a.n = 0 OR greatest(a.hi, e.x) - least(a.lo, e.x) <= 2)"
    grown = state("a.k", "a.n + 1", "CASE WHEN a.n = 0 THEN e.x ELSE least(a.lo, e.x) END", "CASE WHEN a.n = 0 THEN e.x ELSE greatest(a.hi, e.x) END", "e.x")
    again = state("a.k", "2", "least(a.last, e.x)", "greatest(a.last, e.x)", "e.x")
    fresh = state("a.k + CASE WHEN a.n >= 3 THEN 1 ELSE 0 END", "CASE WHEN e.x <= 6 THEN 1 ELSE 0 END", "e.x", "e.x", "e.x")
    step = f"CASE WHEN {fits} THEN {grown} WHEN a.n = 2 AND e.x <= 6 AND abs(a.last - e.x) <= 2 THEN {again} ELSE {fresh} END"
    each_ = f"list_transform({lengths}, lambda v: {{'k': 0::BIGINT, 'n': 0::BIGINT, 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'last': 0::BIGINT, 'x': v::BIGINT}})"
    return run(each_, "{'k': 0::BIGINT, 'n': 0::BIGINT, 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'last': 0::BIGINT, 'x': 0::BIGINT}", step, "a.k + CASE WHEN a.n >= 3 THEN 1 ELSE 0 END")


def anaphora(firsts: str) -> str:
    step = f"CASE WHEN a.last = e.x AND NOT list_contains({array(lex.PRONOUNS)}, e.x) THEN {{'k': a.k, 'n': a.n + 1, 'last': e.x, 'x': ''}} ELSE {{'k': a.k + CASE WHEN a.n >= 3 THEN 1 ELSE 0 END, 'n': 1, 'last': e.x, 'x': ''}} END"
    each_ = f"list_transform({firsts}, lambda v: {{'k': 0::BIGINT, 'n': 0::BIGINT, 'last': '', 'x': v}})"
    return run(each_, "{'k': 0::BIGINT, 'n': 0::BIGINT, 'last': '', 'x': ''}", step, "a.k + CASE WHEN a.n >= 3 THEN 1 ELSE 0 END")


def aphoristic(x: str) -> str:
    t = words(x)
    verb = tx.APHORISM_VERB.replace("'", "''")
    return rf"(len({t}) BETWEEN 4 AND 15 AND ends_with(rtrim({x}), '.') AND NOT regexp_matches({x}, '\d|\[[A-Z]+\]') AND NOT list_contains({array(lex.DEMONSTRATIVES)}, lower(({t})[1])) AND len(list_filter(({t})[2:], lambda w: regexp_matches(w, '^[A-Z]'))) = 0 AND list_has_any(list_transform({t}, lambda w: lower(w)), {array(lex.ABSTRACT)}) AND regexp_matches({x}, '{verb}'))"


def told(source: str, name: str = "tel", keep_columns: str = "record_id, recipient_class") -> str:
    """CTEs up to ``name``: source (with body) with a column for each tell."""
    heading = r"^\s{0,3}(?:#{1,6}[ \t]+\S|\*\*[^*\n]+\*\*\s*$|__[^_\n]+__\s*$)"
    bullet, bold = r"^\s*(?:[-*•+]|\d+[.)])\s+", r"^\s*(?:[-*•+]|\d+[.)])\s+\*\*[^*\n]+\*\*"
    prose = strip(f"array_to_string(list_filter({lines('b')}, lambda x: NOT regexp_matches(x, '{heading}') AND NOT regexp_matches(x, '{bullet}')), chr(10))")
    blocks_of = lambda c: keep(each(rf"string_split(regexp_replace({c}, '\n\s*\n', chr(3), 'g'), chr(3))", "b", prose), "b", has_word("b"))
    blocks = blocks_of("body")
    parts = f"string_split(array_to_string({each(lines('body'), 'x', f'CASE WHEN regexp_matches(x, {q(heading)}) THEN chr(4) ELSE x END')}, chr(10)), chr(4))"
    sections = keep(each(parts, "z", f"({each(blocks_of('z'), 'b', sentences('b'))})"), "g", "true")
    per = lambda c, scale: f"CASE WHEN n >= {tx.MIN_WORDS} THEN ({c}) * {scale}.0 / n END"
    pat = lambda p: q(p.replace("(?U)", ""))
    lexicon = lambda terms: " + ".join(phrase_count("body", t) for t in terms)
    mean = "(list_sum(ln)::DOUBLE / len(ln))"
    values = {
        "sentence_cv": f"CASE WHEN len(ln) >= 8 THEN sqrt(greatest(list_sum(list_transform(ln, lambda x: x * x))::DOUBLE / len(ln) - {mean} * {mean}, 0)) / {mean} END",
        "ing_tail_rate": rf"CASE WHEN len(ln) >= 5 THEN len(list_filter(regexp_extract_all(prose, ',\s+([a-z]+ing)\b', 1), lambda x: NOT list_contains({array(lex.ING_STOP)}, x))) * 100.0 / len(ln) END",
        "tricolon_rate": per(count("prose", pat(tx.TRICOLON)), 1000),
        "tricolon_paragraphs": held("blocks", "b", f"{count('b', pat(tx.TRICOLON))} >= 2"),
        "negation_contrast_rate": per(count("prose", pat(tx.CONTRAST)), 1000),
        "ai_vocab_rate": per(lexicon(lex.AI_VOCABULARY), 500),
        "staccato_runs": f"coalesce(list_sum(list_transform(paras, lambda g: {staccato(each('g', 'y', n_words('y')))})), 0)",
        "anaphora_runs": anaphora(each("flat", "y", f"lower(({words('y')})[1])")),
        "aphorism_ratio": f"CASE WHEN len(finals) > 0 THEN {held('finals', 'y', aphoristic('y'))} * 1.0 / len(finals) END",
        "heading_density": per(held(lines("body"), "x", f"regexp_matches(x, '{heading}')"), 300),
        "bold_first_bullets": f"CASE WHEN len(bul) >= 3 THEN {held('bul', 'x', f'regexp_matches(x, {q(bold)})')} * 1.0 / len(bul) END",
        "pivot_paragraphs": rf"len(list_filter(range(2, len(blocks)), lambda i: bw[i] <= 12 AND regexp_matches(blocks[i], '[.!?]\s*$') AND NOT regexp_matches(blocks[i], '\d') AND bw[i - 1] > 25 AND bw[i + 1] > 25))",
        "connector_rate": per(held("flat", "x", f"regexp_matches(x, {pat(tx.CONNECTOR)})"), 1000),
        "balanced_openers": per(held("flat", "x", f"regexp_matches(x, {pat(tx.BALANCED)})"), 1000),
        "magic_adverb_rate": per(lexicon(lex.MAGIC_ADVERBS), 1000),
        "hedge_stacks": count("body", pat(tx.HEDGE_STACK)),
        "service_phrases": " + ".join(f"regexp_matches(body, {pat(p)})::INT" for p in tx.SERVICE),
        "paragraph_mean": "CASE WHEN len(blocks) >= 4 THEN len(flat) * 1.0 / len(blocks) END",
        "single_share": "CASE WHEN len(blocks) >= 4 THEN len(list_filter(paras, lambda x: len(x) = 1)) * 1.0 / len(blocks) END",
    }
    columns = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in values.items())
    return rf"""{name}_a AS (SELECT *, {blocks} AS blocks, {keep(lines("body"), "x", f"regexp_matches(x, '{bullet}')")} AS bul, {n_words("body")} AS n FROM {source}),
{name}_b AS (SELECT *, list_transform(blocks, lambda b: {sentences("b")}) AS paras, array_to_string(blocks, chr(10) || chr(10)) AS prose, list_transform(blocks, lambda b: {n_words("b")}) AS bw FROM {name}_a),
{name}_c AS (SELECT *, flatten(paras) AS flat FROM {name}_b),
{name}_d AS (SELECT *, list_transform(flat, lambda x: {n_words("x")}) AS ln, CASE WHEN {held(lines("body"), "x", f"regexp_matches(x, '{heading}')")} > 0 THEN list_filter(list_transform({sections}, lambda g: (flatten(g))[-1]), lambda y: y IS NOT NULL) ELSE list_transform(list_filter(paras, lambda g: len(g) >= 2), lambda g: g[-1]) END AS finals FROM {name}_c),
{name} AS (SELECT {keep_columns}, {columns} FROM {name}_d)"""
