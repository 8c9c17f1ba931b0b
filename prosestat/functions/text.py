"""Tokens, sentences, structure and metrics of texts as Column expressions.

Everything stays in the JVM: regexes and higher-order functions, no Python workers.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lex

# The patterns of words and list lines.
WORD = r"\[[A-Z]+\]|[A-Za-z]+(?:'[A-Za-z]+)?"
LIST_LINE = r"^\s*(?:[-*+] |\d+\. )"
#: Marks inside intermediate strings: a cut, a list item, a protected full stop.
CUT, ITEM, DOT = "\x03", "\x01", "\x02"

METRICS = (
    "words sentence_len paragraph_len paragraphs contraction_rate question_softener_rate question_rate exclamation_rate "
    "exclamations_per_email parenthetical_rate ellipsis_rate spaced_dash_rate emoji_rate first_person_rate second_person_rate "
    "list_use heading_use flesch_reading_ease greeting_share signoff_share"
).split()

TELLS = {
    "sentence_cv": "min",
    "ing_tail_rate": "max",
    "tricolon_rate": "max",
    "tricolon_paragraphs": "max",
    "negation_contrast_rate": "max",
    "ai_vocab_rate": "max",
    "staccato_runs": "max",
    "anaphora_runs": "max",
    "aphorism_ratio": "max",
    "heading_density": "max",
    "bold_first_bullets": "max",
    "pivot_paragraphs": "max",
    "connector_rate": "max",
    "balanced_openers": "max",
    "magic_adverb_rate": "max",
    "hedge_stacks": "max",
    "service_phrases": "max",
}
MIN_WORDS = 150


def let(value: Column, use) -> Column:
    """use(value) with value computed once, where a lambda would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns as they are, but as rows of a generator: a filter on them isn't
    pushed into what computes them, which would then run twice."""
    return df.select(*(c for c in df.columns if c not in names), F.inline(F.array(F.struct(*names))))


def normalize(c: Column) -> Column:
    """Typographic apostrophes as plain ones."""
    for sign in "’‘ʼ\x92":
        c = F.replace(c, F.lit(sign), F.lit("'"))
    return c


#: White space of Unicode, that of ASCII, and that within a line.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PLAIN = "\t\n\x0b\x0c\r "
BLANKS = "\t\x0b\x0c\r "


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    return plain_words(normalize(c))


def plain_words(c: Column) -> Column:
    """Words of a text whose apostrophes are plain."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def has_word(c: Column) -> Column:
    return F.rlike(c, F.lit(r"\[[A-Z]+\]|[A-Za-z]"))


def n_words(c: Column) -> Column:
    return n_plain_words(normalize(c))


def n_plain_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def word_count(c: Column) -> Column:
    """Words of ASCII letters alone, without mask tokens as words of their own kind."""
    return F.regexp_count(c, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?"))


def newlines(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "[\x0b-\r\x1c-\x1e\x85\u2028\u2029]", "\n")


def lines(c: Column) -> Column:
    """The lines of a text; a final line end begins no further line."""
    return plain_lines(newlines(c))


def plain_lines(c: Column) -> Column:
    """The lines of a text that has no line ends but line feeds."""
    return F.split(let(c, lambda x: F.when(F.endswith(x, F.lit("\n")), F.substring(x, F.lit(1), F.char_length(x) - 1)).otherwise(x)), "\n", -1)


def paragraphs(c: Column) -> Column:
    return F.split(c, r"\n\s*\n", -1)


def phrase(term: str) -> str:
    return rf"(?i)(?<![A-Za-z])\Q{term}\E(?![A-Za-z])"


def phrase_count(c: Column, term: str) -> Column:
    return F.regexp_count(c, F.lit(phrase(term)))


def any_phrase(terms: list[str]) -> str:
    return r"(?i)(?<![A-Za-z])(?:" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?![A-Za-z])"


def _apart(terms: list[str]) -> bool:
    """Whether no two matches of the terms can overlap: no term holds another one, and none ends
    as another one begins."""
    words = [re.findall(r"[a-z]+", t.lower()) for t in terms]
    plain = all(" ".join(w) == t.lower() for w, t in zip(words, terms, strict=True))
    ends = {tuple(w[k:]) for w in words for k in range(1, len(w))}
    starts = {tuple(w[:k]) for w in words for k in range(1, len(w) + 1)}
    inner = any(a != b and f" {' '.join(a)} " in f" {' '.join(b)} " for a in words for b in words)
    return plain and not inner and not ends & starts


def phrase_counts(c: Column, terms: list[str]) -> Column:
    """Counts of the terms, in their order. Terms that can't overlap are found in one pass."""
    if not _apart(terms):
        return F.array(*(phrase_count(c, t) for t in terms))
    found = F.transform(F.regexp_extract_all(c, F.lit(any_phrase(terms)), F.lit(0)), F.lower)
    return let(found, lambda hits: F.transform(F.lit([t.lower() for t in terms]), lambda t: F.size(F.filter(hits, lambda h: h == t))))


def listed(runs: Column, terms: list[str]) -> Column:
    """How many of the runs of letters, in lower case, are one of the terms, single words."""
    return F.size(F.filter(runs, lambda r: r.isin([t.lower() for t in terms])))


#: Full stops that end no sentence: in and after abbreviations, and between digits. All are
#: looked for at full stops alone, in one pass.
def _protected() -> str:
    runs = [a.rstrip(".").split(".") for a in lex.ABBREVIATIONS]
    last = "|".join(sorted((r"\.".join(r) for r in runs), key=len, reverse=True))
    inner = "".join(rf"|(?<={r[0]}\.)(?={r[1]}\.)" for r in runs if len(r) > 1)
    return rf"(?i)\.(?:(?<=(?:{last})\.){inner}|(?<=\d\.)(?=\d))"


PROTECTED = _protected()


# List lines and the places where sentences end, as single passes.
ITEM_LINE = rf"(?<![^\n{CUT}])(?:[-*+] |\d+\. )([^\n{CUT}]*)"
SENTENCE_CUT = rf"[\n{CUT}](?:(?<={CUT})\n?|{CUT}\n?|(?=[A-Z])|(?<=[.!?]\n))"


def sentences(c: Column) -> Column:
    """Sentences with at least one word.

    Abbreviations and decimal points are protected; a blank line ends a chunk; a list line is
    one sentence; a line begins a new chunk after closing punctuation or with a capital, and
    otherwise goes on; chunks are cut after closing punctuation and white space.
    """
    return plain_sentences(newlines(c))


def plain_sentences(c: Column) -> Column:
    """Sentences of a text that has no line ends but line feeds."""
    t = F.regexp_replace(c, PROTECTED, DOT)
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))), "\n")
    t = F.regexp_replace(strip(t), r"\n{2,}", CUT)
    t = F.regexp_replace(t, ITEM_LINE, f"{CUT}{ITEM}$1{CUT}")
    t = F.replace(F.regexp_replace(t, SENTENCE_CUT, CUT), F.lit("\n"), F.lit(" "))
    parts = F.transform(F.split(t, CUT, -1), lambda x: F.when(F.startswith(x, F.lit(ITEM)), F.array(F.substring(x, F.lit(2), F.char_length(x)))).otherwise(F.split(x, r"(?<=[.!?])\s+", -1)))
    return F.filter(F.transform(F.flatten(parts), lambda x: F.replace(x, F.lit(DOT), F.lit("."))), has_word)


# The patterns of greetings.
GREETING = r"(?i)^(?:Hi|Hey|Hello|Heya|Dear|Morning|Good (?:day|morning|afternoon|evening))\b\s*([^,\n]{1,40})?,"
BARE_NAME = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}),"


def greeting(first_line: Column) -> Column:
    """The greeting that a line begins with, names masked; null without one."""
    polite, bare = F.regexp_extract(first_line, GREETING, 0), F.regexp_extract(first_line, BARE_NAME, 0)
    name = F.regexp_extract(first_line, GREETING, 1)
    masked = F.concat(F.substring(polite, F.lit(1), F.char_length(polite) - F.char_length(name) - 1), F.lit("[NAME],"))
    is_name = (strip(name) != "") & ~F.lower(strip(name)).isin(lex.GROUPS)
    bare_name = ~F.lower(F.regexp_replace(bare, ",$", "")).isin(lex.GROUPS)
    return F.when(polite != "", F.when(is_name, masked).otherwise(polite)).when(bare != "", F.when(bare_name, F.lit("[NAME],")).otherwise(bare))


def canonical_line(line: Column) -> Column:
    return F.lower(F.rtrim(strip(line), F.lit(",.!")))


def valediction(line: Column) -> Column:
    """Whether a line is a valediction; nearly all are ruled out by their first letters."""
    head = F.lower(F.substring(F.ltrim(line, F.lit(SPACES)), 1, 4))
    return head.isin(sorted({v[:4] for v in lex.VALEDICTIONS})) & canonical_line(line).isin(lex.VALEDICTIONS)


def signoff(all_lines: Column) -> Column:
    """The last valediction in the last six lines, or null."""
    tail = F.slice(all_lines, F.greatest(F.size(all_lines) - 5, F.lit(1)), F.lit(6))
    return F.try_element_at(F.filter(F.transform(tail, canonical_line), lambda x: x.isin(lex.VALEDICTIONS)), F.lit(-1))


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    """df with greeting, signoff and body, the text that metrics are taken of. Apostrophes of the
    body are plain and its line ends are line feeds."""
    out = df.withColumn("_all", lines(strip(normalize(F.coalesce(text, F.lit(""))))))
    out = out.withColumn("greeting", greeting(F.get("_all", F.lit(0)))).withColumn("signoff", signoff(F.col("_all")))
    rest = F.when(F.col("greeting").isNotNull(), F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0)))).otherwise(F.col("_all"))
    kept = F.filter(rest, lambda x: F.col("signoff").isNull() | (canonical_line(x) != F.col("signoff")))
    return out.withColumn("body", strip(F.array_join(kept, "\n"))).drop("_all")


def syllables(token: Column) -> Column:
    return syllables_of(F.array(F.lower(token)))


def syllables_of(low: Column) -> Column:
    """Syllables of words in lower case: runs of vowels, or one in a word without any; a final e
    is silent unless it is the only run or comes after l or y."""
    runs = F.regexp_count(F.concat(F.lit(" "), F.array_join(low, " "), F.lit(" ")), F.lit("[aeiouy]+|(?<= )[^ aeiouy]+(?= )"))
    ends = lambda t, *what: reduce(lambda x, y: x | y, (F.endswith(t, F.lit(w)) for w in what))
    silent = F.filter(low, lambda t: ends(t, "e") & ~ends(t, "le", "ye") & F.rlike(t, F.lit("[aeiouy][^aeiouy]+[aeiouy]")))
    return runs - F.size(silent)


def emoji(c: Column) -> Column:
    """How many emoji there are; what lies outside their first and last ones is cut away first."""
    spans = [[int(x, 16) for x in r.split("..")] for r in lex.EMOJI]
    near = "".join(f"{chr(min(r)[0])}-{chr(max(r)[-1])}" for r in ([x for x in spans if x[0] < 0x10000], [x for x in spans if x[0] >= 0x10000]))
    return F.regexp_count(F.regexp_replace(c, f"[^{near}]+", ""), F.lit(lex.emoji_class()))


def heading_lines(c: Column, html: bool = False) -> Column:
    """Flags for each line: a heading of the number-sign, bold or underlined form."""
    every = F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n", -1), strip)
    bold = r"^(?:\*\*\S(?:.*\S)?\*\*|__\S(?:.*\S)?__)$" if not html else r"^(?:\*\*\S(?:.*\S)?\*\*|__\S(?:.*\S)?__|\*\S(?:.*\S)?\*)$"

    def flags(rows: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            under = F.coalesce(F.rlike(F.get(rows, i + 1), F.lit(r"^(?:=+|-+)$")), F.lit(False))
            return F.rlike(x, F.lit(r"^#{1,6}[ \t]+")) | F.rlike(x, F.lit(bold)) | (under & has_word(normalize(x)) & ~F.rlike(x, F.lit(LIST_LINE)) & ~F.startswith(x, F.lit(">")))

        return F.transform(rows, one)

    return let(every, flags)


def rate(count: Column, of: Column, scale: float) -> Column:
    return F.when(of > 0, count * float(scale) / of).otherwise(F.lit(0.0))


def measured(df: DataFrame, softeners: list[str] = lex.SOFTENERS, html: bool = False) -> DataFrame:
    """df (with body, greeting, signoff of ``prepared``) with one double column for each of
    METRICS, and ``gated``: long enough for rates."""
    b = F.col("body")
    out = df.withColumn("_tok", plain_words(b)).withColumn("_sents", plain_sentences(b)).withColumn("_low", F.transform("_tok", F.lower))
    out = out.withColumn("_n", F.size("_tok")).withColumn("_s", F.size("_sents")).withColumn("_p", F.size(F.filter(paragraphs(b), has_word)))
    n, s, p, low, sents = (F.col(c) for c in ("_n", "_s", "_p", "_low", "_sents"))

    def held(array: Column, test) -> Column:
        return F.size(F.filter(array, test))

    contracted = held(low, lambda t: F.contains(t, F.lit("'")) & (F.rlike(t, F.lit(r"(?:n't|'m|'re|'ve|'ll|'d)$")) | t.isin(lex.CONTRACTED)))
    values = {
        "words": n,
        "sentence_len": rate(n, s, 1),
        "paragraph_len": rate(s, p, 1),
        "paragraphs": p,
        "contraction_rate": rate(contracted, n, 100),
        "question_softener_rate": rate(held(sents, lambda x: F.endswith(x, F.lit("?")) & F.rlike(x, F.lit(any_phrase(softeners)))), s, 100),
        "question_rate": rate(held(sents, lambda x: F.endswith(x, F.lit("?"))), s, 100),
        "exclamation_rate": rate(held(sents, lambda x: F.endswith(x, F.lit("!"))), s, 100),
        "exclamations_per_email": F.regexp_count(b, F.lit("!")),
        "parenthetical_rate": rate(held(F.regexp_extract_all(b, F.lit(r"\([^()]*\)"), F.lit(0)), has_word), s, 100),
        "ellipsis_rate": rate(F.regexp_count(b, F.lit(r"\.\.\.|…")), n, 1000),
        "spaced_dash_rate": rate(F.regexp_count(b, F.lit(r"(?<=[A-Za-z\]]) [–—-] (?=[A-Za-z\[])")), n, 1000),
        "emoji_rate": emoji(b) + F.regexp_count(b, F.lit(r"[:;](?:(?<=:)(?:D|-?\))|(?<=;)\))")),
        "first_person_rate": rate(held(low, lambda t: t.isin("i", "me", "my", "mine")), n, 100),
        "second_person_rate": rate(held(low, lambda t: t.isin("you", "your", "yours")), n, 100),
        "list_use": F.exists(plain_lines(b), lambda x: F.rlike(x, F.lit(LIST_LINE))).cast("int"),
        "heading_use": F.exists(heading_lines(b, html), lambda x: x).cast("int"),
        "flesch_reading_ease": F.when((n > 0) & (s > 0), 206.835 - 1.015 * n / s - 84.6 * syllables_of(low) / n).otherwise(F.lit(0.0)),
        "greeting_share": F.col("greeting").isNotNull().cast("int"),
        "signoff_share": F.col("signoff").isNotNull().cast("int"),
    }
    out = out.withColumns({k: v.cast("double") for k, v in values.items()})
    return out.withColumn("gated", (n >= 80) & (s >= 5)).drop("_tok", "_sents", "_low", "_n", "_s", "_p")


# The patterns of the habits.
HEADING = r"^\s{0,3}(?:#{1,6}[ \t]+\S|\*\*[^*\n]+\*\*\s*$|__[^_\n]+__\s*$)"
BULLET = r"^\s*(?:[-*•+]|\d+[.)])\s+"
BOLD_BULLET = r"^\s*(?:[-*•+]|\d+[.)])\s+\*\*[^*\n]+\*\*"
TRICOLON = r"(?U)\b\w+(?:\s\w+){0,3},\s+\w+(?:\s\w+){0,3},?\s+(?:and|or)\s+\w+(?:\s\w+){0,3}\b"
CONTRAST = r"(?i)\bnot\s+[^.!?\n,;]{1,40},?\s+but\s+|\brather than\b"
CONNECTOR = r"^(?:Moreover|Furthermore|Additionally|Notably|Importantly|Interestingly|However|Also|Therefore|Thus|Consequently|Similarly|Meanwhile|Instead|Indeed)\b"
BALANCED = r"^(?:While|Although|Though|Whilst)\b[^,]{5,80},"
HEDGE_STACK = r"(?i)\b(?:could|may|might|can)\s+(?:potentially|possibly|eventually|perhaps)\b"
SERVICE = (
    r"(?i)\b(?:don't|do not) hesitate to\b",
    r"(?i)\bfeel free to (?:reach out|contact|let me know|get in touch|call)\b",
    r"(?i)\blet me know if (?:there's|there is|you have|you need) anything else\b",
    r"(?i)\bI hope this helps\b",
    r"(?i)\bwould you like me to\b",
)
#: What a text in lower case holds if it matches.
SERVICE_PARTS = ("hesitate to", "feel free to", "let me know if", "i hope this helps", "would you like me to")
APHORISM_VERB = r"(?i)\b(?:is|are|in the end|ultimately|after all|at the end of the day)\b"


#: TRICOLON as Java matches it without going back into words: what follows a word is no word sign.
TRICOLON_RUN = r"(?U)\b\w++(?:\s\w++){0,3}+,\s+\w++(?:\s\w++){0,3},?\s+(?:and|or)\s+\w++(?:\s\w++){0,3}+"


def _begins(x: Column, signs: str) -> Column:
    """Whether the first sign of a line that is no white space is one of the signs."""
    return F.substring(F.ltrim(x, F.lit(PLAIN)), 1, 1).isin(list(signs))


def is_heading(x: Column) -> Column:
    return _begins(x, "#*_") & F.rlike(x, F.lit(HEADING))


def is_bullet(x: Column) -> Column:
    return _begins(x, "-*•+0123456789") & F.rlike(x, F.lit(BULLET))


def opens(x: Column, pattern: str) -> Column:
    """Whether a sentence begins with one of the words that the pattern lists first. Most are ruled
    out by four letters, where the pattern would be tried at every place."""
    listed_words = re.match(r"\^\(\?:([A-Za-z|]+)\)", pattern)[1].split("|")
    return F.substring(x, 1, 4).isin(sorted({w[:4] for w in listed_words})) & F.rlike(x, F.lit(pattern))


def prose(block: Column) -> Column:
    """A block's lines that are neither headings nor bullets."""
    return strip(F.array_join(F.filter(plain_lines(block), lambda x: ~is_heading(x) & ~is_bullet(x)), "\n"))


def prose_blocks(c: Column) -> Column:
    return F.filter(F.transform(paragraphs(c), prose), has_word)


def staccato(lengths: Column) -> Column:
    """Runs of three or more sentences of up to six words whose lengths differ by two at most.
    A run that stays too short is tried again from its second sentence."""
    state = lambda k, n, lo, hi, last: F.struct(k.alias("k"), n.alias("n"), lo.alias("lo"), hi.alias("hi"), last.alias("last"))
    zero = F.lit(0)

    def step(a: Column, x: Column) -> Column:
        fits = (x <= 6) & ((a["n"] == 0) | (F.greatest(a["hi"], x) - F.least(a["lo"], x) <= 2))
        done = F.when(a["n"] >= 3, 1).otherwise(0)
        pair = (a["n"] == 2) & (x <= 6) & (F.abs(a["last"] - x) <= 2)
        fresh = F.when(x <= 6, 1).otherwise(0)
        grown = state(a["k"], a["n"] + 1, F.when(a["n"] == 0, x).otherwise(F.least(a["lo"], x)), F.when(a["n"] == 0, x).otherwise(F.greatest(a["hi"], x)), x)
        again = state(a["k"], F.lit(2), F.least(a["last"], x), F.greatest(a["last"], x), x)
        return F.when(fits, grown).when(pair, again).otherwise(state(a["k"] + done, fresh, x, x, x))

    return F.aggregate(lengths, state(zero, zero, zero, zero, zero), step, lambda a: a["k"] + F.when(a["n"] >= 3, 1).otherwise(0))


def anaphora(firsts: Column) -> Column:
    """Runs of three or more sentences that begin with the same word, no pronoun."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit("").alias("last"))

    def step(a: Column, x: Column) -> Column:
        same = (a["last"] == x) & ~x.isin(lex.PRONOUNS)
        return F.when(same, F.struct(a["k"].alias("k"), (a["n"] + 1).alias("n"), x.alias("last"))).otherwise(F.struct((a["k"] + F.when(a["n"] >= 3, 1).otherwise(0)).alias("k"), F.lit(1).alias("n"), x.alias("last")))

    return F.aggregate(firsts, start, step, lambda a: a["k"] + F.when(a["n"] >= 3, 1).otherwise(0))


def aphoristic(x: Column) -> Column:
    ok = F.endswith(F.rtrim(x), F.lit(".")) & F.rlike(x, F.lit(APHORISM_VERB)) & ~F.rlike(x, F.lit(r"\d|\[[A-Z]+\]"))

    def of(t: Column) -> Column:
        fits = F.size(t).between(4, 15) & ~F.lower(F.get(t, F.lit(0))).isin(lex.DEMONSTRATIVES) & ~F.exists(F.slice(t, 2, 100), lambda w: F.rlike(w, F.lit("^[A-Z]")))
        return fits & F.arrays_overlap(F.transform(t, F.lower), F.lit(lex.ABSTRACT))

    return ok & let(plain_words(x), of)


def _trie(terms: list[str]) -> str:
    """A pattern of any of the terms, which are plain letters, with shared beginnings once."""
    rest = {a: [t[1:] for t in terms if t[:1] == a] for a in sorted({t[0] for t in terms if t})}
    found = [a + _trie(r) for a, r in rest.items()]
    whole = found[0] if len(found) == 1 else "(?:" + "|".join(found) + ")" if found else ""
    return f"(?:{whole})?" if found and "" in terms else whole


def told(df: DataFrame) -> DataFrame:
    """df (with body of ``prepared``) with one double column for each of TELLS, null where it
    doesn't apply."""
    b = F.col("body")
    total = lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + x)
    out = df.withColumn("_blocks", prose_blocks(b)).withColumn("_paras", F.transform("_blocks", plain_sentences)).withColumn("_flat", F.flatten("_paras"))
    # Sentences hold all words of their block.
    out = out.withColumn("_lens", F.transform("_paras", lambda g: F.transform(g, n_plain_words))).withColumn("_len", F.flatten("_lens")).withColumn("_bw", F.transform("_lens", total))
    out = out.withColumn("_n", n_plain_words(b)).withColumn("_lines", plain_lines(b)).withColumn("_prose", F.array_join("_blocks", "\n\n"))
    out = out.withColumn("_heads", F.size(F.filter("_lines", is_heading))).withColumn("_bullets", F.filter("_lines", is_bullet)).withColumn("_tri", F.regexp_count("_prose", F.lit(TRICOLON_RUN)))
    out = out.withColumn("_listed", F.transform(F.regexp_extract_all(b, F.lit(r"(?i)(?<![A-Za-z])" + _trie([*lex.AI_VOCABULARY, *lex.MAGIC_ADVERBS]) + r"(?![A-Za-z])"), F.lit(0)), F.lower)).withColumn("_low", F.lower(b))
    cut = F.split(F.array_join(F.transform("_lines", lambda x: F.when(is_heading(x), F.lit(CUT)).otherwise(x)), "\n"), CUT, -1)
    sections = F.transform(cut, lambda part: F.try_element_at(F.flatten(F.transform(prose_blocks(part), plain_sentences)), F.lit(-1)))
    plain = F.transform(F.filter("_paras", lambda g: F.size(g) >= 2), lambda g: F.element_at(g, -1))
    out = out.withColumn("_finals", F.when(F.col("_heads") > 0, F.filter(sections, lambda x: x.isNotNull())).otherwise(plain))
    n, flat, size = F.col("_n"), F.col("_flat"), F.size("_len")
    per = lambda count, scale: F.when(n >= MIN_WORDS, count * float(scale) / n)
    mean = F.aggregate("_len", F.lit(0.0), lambda a, x: a + x) / F.when(size > 0, size)
    var = F.aggregate("_len", F.lit(0.0), lambda a, x: a + x * x) / F.when(size > 0, size) - mean * mean
    ends = lambda x: F.rlike(x, F.lit(r"[.!?]\s*$")) & ~F.rlike(x, F.lit(r"\d"))
    inner = F.filter(F.sequence(F.lit(0), F.size("_blocks")), lambda i: (i >= 1) & (i < F.size("_blocks") - 1) & (F.get("_bw", i) <= 12) & (F.get("_bw", i - 1) > 25) & (F.get("_bw", i + 1) > 25) & ends(F.get("_blocks", i)))
    held = lambda array, test: F.size(F.filter(array, test))
    bold = held("_bullets", lambda x: F.rlike(x, F.lit(BOLD_BULLET)))
    values = {
        "sentence_cv": F.when(size >= 8, F.sqrt(F.greatest(var, F.lit(0.0))) / mean),
        "ing_tail_rate": F.when(size >= 5, held(F.regexp_extract_all("_prose", F.lit(r",\s+([a-z]+ing)\b"), F.lit(1)), lambda x: ~x.isin(lex.ING_STOP)) * 100.0 / size),
        "tricolon_rate": per(F.col("_tri"), 1000),
        "tricolon_paragraphs": F.when(F.col("_tri") > 0, held("_blocks", lambda x: F.regexp_count(x, F.lit(TRICOLON_RUN)) >= 2)).otherwise(0),
        "negation_contrast_rate": per(F.regexp_count("_prose", F.lit(CONTRAST)), 1000),
        "ai_vocab_rate": per(listed(F.col("_listed"), lex.AI_VOCABULARY), 500),
        "staccato_runs": F.aggregate("_lens", F.lit(0), lambda a, g: a + F.when(F.size(F.filter(g, lambda x: x <= 6)) >= 3, staccato(g)).otherwise(0)),
        "anaphora_runs": anaphora(F.transform(flat, lambda x: F.lower(F.regexp_extract(x, WORD, 0)))),
        "aphorism_ratio": F.when(F.size("_finals") > 0, held("_finals", aphoristic) * 1.0 / F.size("_finals")),
        "heading_density": per(F.col("_heads"), 300),
        "bold_first_bullets": F.when(F.size("_bullets") >= 3, bold * 1.0 / F.size("_bullets")),
        "pivot_paragraphs": F.size(inner),
        "connector_rate": per(held(flat, lambda x: opens(x, CONNECTOR)), 1000),
        "balanced_openers": per(held(flat, lambda x: opens(x, BALANCED)), 1000),
        "magic_adverb_rate": per(listed(F.col("_listed"), lex.MAGIC_ADVERBS), 1000),
        "hedge_stacks": F.regexp_count(b, F.lit(HEDGE_STACK)),
        "service_phrases": reduce(lambda x, y: x + y, ((F.contains("_low", F.lit(part)) & F.rlike(b, F.lit(p))).cast("int") for part, p in zip(SERVICE_PARTS, SERVICE, strict=True))),
    }
    shape = F.size("_blocks") >= 4
    counts = F.transform("_paras", F.size)
    out = out.withColumns({k: v.cast("double") for k, v in values.items()})
    out = out.withColumn("paragraph_mean", F.when(shape, F.aggregate(counts, F.lit(0), lambda a, x: a + x) * 1.0 / F.size("_blocks"))).withColumn("single_share", F.when(shape, F.size(F.filter(counts, lambda x: x == 1)) * 1.0 / F.size("_blocks")))
    return out.drop(*[c for c in out.columns if re.match("_(blocks|paras|flat|lens|len|n|lines|prose|heads|bullets|bw|finals|tri|listed|low)$", c)])
