"""Text functions as Column expressions: cleaning, tokens, headings, sentences, the quality gate.

Everything stays in the JVM.  Character classes are spelled out, since ``\\w`` and ``\\s``
mean different sets in different regex engines: words are letters, digits and underscore of
any script, white space is the six ASCII characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal for ranking.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "this", "that",
    "these", "those", "it", "its", "also", "such", "their", "they", "them", "we", "our", "can", "which", "into", "per", "under", "through",
    "between", "among", "above", "below", "than", "more", "most", "not", "no", "nor", "so", "if", "then", "each", "other", "all", "any",
)

# Characters that PDF extraction leaves behind, and what they stand for.
LIGATURES = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff",
    "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "--",
    "­": "", " ": " ", "​": "", "�": "",
}

# What is noise on a page, each replaced by one space, in this order.
NOISE = (
    r"(?md)^[ \t\n\r\f]*[0-9]{1,4}[ \t\n\r\f]*$",
    r"(?i)Please use this shareable version[^\n]*",
    r"(?md)^[ \t\n\r\f]*-[ \t\n\r\f]*[0-9]+[ \t\n\r\f]*-[ \t\n\r\f]*$",
    r"(?mdi)^[ \t\n\r\f]*Page [0-9]+ of [0-9]+[ \t\n\r\f]*$",
    r"\f",
    r"[ \t]{3,}",
    r"\n{3,}",
)

# How a heading begins.
HEADING = (
    r"^(?:(?:Chapter|Section|Part|Annex|Appendix)[ \t\n\r\f]+[0-9A-Z]+[ \t\n\r\f:–-]"
    r"|[A-Z][A-Z \t\n\r\f]{2,40}$"
    r"|[0-9]{1,2}(?:\.[0-9]{1,2}){0,2}[ \t\n\r\f.]+[A-Z]"
    r"|[A-Z][.)][ \t\n\r\f]+[A-Z]"
    r"|[IVX]+[.)][ \t\n\r\f]+[A-Z])"
)

# Abbreviations whose dots end no sentence.
ABBREVIATIONS = (
    r"No\.|para\.|Fig\.|Eq\.|Vol\.|pp\.|et al\.|e\.g\.|i\.e\.|vs\.|approx\.|govt\.|dept\.|MtCO2e?\.|GtCO2e?\.|GWP\.|NDC\.|INDC\.|AR[0-9]\."
)

# Arrows and triangles of figures.
ARROWS = "▲▼▶◀→←↑↓►◄▸◂△▽"

#: Characters of words, and of anything but white space.
WORD, VISIBLE = r"[\p{L}\p{N}_]", r"[^\x09-\x0D\x20]"


def split_words(text: Column) -> Column:
    """Runs of non-white-space; no empty strings."""
    return F.regexp_extract_all(text, F.lit(f"{VISIBLE}+"), F.lit(0))


def tokenise(text: Column) -> Column:
    """Ranking tokens: edges stripped of punctuation, lower case, no stop words, no single characters.

    One match a token: from the first to the last word character of a run without white space.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}(?:{VISIBLE}*{WORD})?"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def overlap_tokens(text: Column) -> Column:
    """Tokens for n-gram overlap: lower case, runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def fix_ligatures(text: Column) -> Column:
    single = {k: v for k, v in LIGATURES.items() if len(v) == 1}
    gone = "".join(k for k, v in LIGATURES.items() if not v)
    text = F.translate(text, "".join(single) + gone, "".join(single.values()))
    for k, v in LIGATURES.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


def fix_hyphenation(text: Column) -> Column:
    return F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def remove_noise(text: Column) -> Column:
    for pattern in NOISE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def normalise_whitespace(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")


def clean_page(text: Column) -> Column:
    """Ligatures, then hyphens at line ends, noise, white space: the order matters."""
    return normalise_whitespace(remove_noise(fix_hyphenation(fix_ligatures(text))))


def heading(line: Column) -> Column:
    """The heading that a line is, cut at 100 characters, or null."""
    s = strip(line)
    return F.when((F.length(s) > 0) & (F.length(s) <= 120) & s.rlike(HEADING), F.substring(s, 1, 100))


def sentences(text: Column) -> Column:
    """Sentences: ends before capitals, digits, quotes and brackets, and at blank lines."""
    marked = F.regexp_replace(text, f"({ABBREVIATIONS})", "\u0002$1\u0003")
    # dots inside marked abbreviations are hidden piece by piece
    pieces = F.transform(F.split(marked, "\u0002"), lambda p: F.when(F.instr(p, "\u0003") > 0, F.concat(F.translate(F.substring_index(p, "\u0003", 1), ".", "\u0001"), F.substring_index(p, "\u0003", -1))).otherwise(p))
    hidden = F.array_join(pieces, "")
    ended = F.regexp_replace(hidden, r"([.!?])[\x09-\x0D\x20]+(?=[A-Z0-9\"(])", "$1\u001e")
    parts = F.split(F.regexp_replace(ended, r"\n\n+", "\u001e"), "\u001e")
    return F.filter(F.transform(parts, lambda p: strip(F.translate(p, "\u0001", "."))), lambda p: p != "")


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def _arrows(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ARROWS, ""))


def _uniform(t: Column) -> Column:
    """Whether a text's words are numbers for the most part, one word over and over, or hardly any prose."""
    n = F.size(t)
    numbers = F.size(F.filter(t, lambda w: F.translate(w, ".%-", "").rlike(r"^\p{Nd}+$")))
    # a word that occurs m times stands m - 1 places after itself in sorted order
    m = F.greatest(F.floor(n / 5).cast("int") + 1, F.lit(5))
    many = lambda s: F.exists(F.zip_with(F.slice(s, 1, n - m + 1), F.slice(s, m, n - m + 1), lambda x, y: x == y), lambda same: same)
    repeated = F.get(F.transform(F.array(F.sort_array(t)), many), F.lit(0))
    long_words = F.size(F.filter(t, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}+$")))
    return (n == 0) | (numbers / n > 0.55) | ((n >= 6) & repeated) | ((n > 10) & (long_words < 8))


def is_garbled(text: Column) -> Column:
    """Whether a chunk is a figure, grid or other non-prose; the first of eight tests that hits decides.

    The text is split into words once, and only if no test of its characters decides.
    """
    window = F.substring(text, 1, 150)
    return (
        F.when(text.isNull() | (F.length(strip(text)) < 20), True)
        .when(_arrows(window) >= 2, True)
        .when((F.length(window) > 30) & (_letters(window) / F.length(window) < 0.25), True)
        .when(_arrows(text) >= 4, True)
        .when(_letters(text) / F.length(text) < 0.35, True)
        .otherwise(F.get(F.transform(F.array(split_words(text)), _uniform), F.lit(0)))
    )


# What makes a question a gap question, or else a comparative one.
GAP_WORDS = ("gap", "compare", "comparison", "versus", "vs", "differ", "shortfall", "insufficient", "aligned", "benchmark", "pathway", "1.5", "2 degree", "2°c")
COMPARATIVE_WORDS = ("compared", "between", "which country", "highest", "lowest", "most", "least", "rank", "best", "worst", "all g20", "across countries")


def classify_query(question: Column) -> Column:
    """``gap``, ``comparative`` or ``factual`` by substrings, in that order."""
    q = F.lower(question)

    def any_of(words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | q.contains(w)
        return found

    return F.when(any_of(GAP_WORDS), "gap").when(any_of(COMPARATIVE_WORDS), "comparative").otherwise("factual")


#: Fixed value: a citation ``[document, p.N]``.
CITATION = r"\[([A-Za-z0-9_.-]+)[\x09-\x0D\x20]*,[\x09-\x0D\x20]*p\.?[\x09-\x0D\x20]*([0-9]+)\]"


def citations(text: Column) -> Column:
    """Array of (doc, page) in order, each once."""
    docs, pages = (F.regexp_extract_all(text, F.lit(CITATION), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.transform(F.arrays_zip(docs.alias("d"), pages.alias("p")), lambda x: F.struct(x["d"].alias("doc"), x["p"].cast("bigint").alias("page"))))


def highlight_citations(text: Column, before: str = "<b>", after: str = "</b>") -> Column:
    return F.regexp_replace(text, CITATION, f"{before}$0{after}")


def is_insufficient(answer: Column) -> Column:
    """Whether an answer begins with the sentinel for missing context."""
    return F.upper(strip(answer)).startswith("INSUFFICIENT_CONTEXT")


def slug(question: Column, length: int = 40) -> Column:
    return F.lower(F.regexp_replace(F.substring(question, 1, length), r"[^\p{L}\p{N}_]+", "_"))


def trim_prompt(prompt: Column, limit: int = 6000, end: int = 2000) -> Column:
    """Long prompts keep their ends."""
    mark = "\n\n[... context trimmed to fit the limit ...]\n\n"
    return F.when(F.length(prompt) > limit, F.concat(F.left(prompt, F.lit(end)), F.lit(mark), F.right(prompt, F.lit(end)))).otherwise(prompt)


def truncate_tokens(tokens: Column, limit: int = 2048, head: int = 512) -> Column:
    tail = limit - head
    return F.when(F.size(tokens) > limit, F.concat(F.slice(tokens, 1, head), F.slice(tokens, -tail, tail))).otherwise(tokens)


def claims(answer: Column, most: int = 8) -> Column:
    """Sentences of over 20 characters as claims, the first ``most``."""
    parts = F.transform(F.split(answer, "[.!?]"), strip)
    return F.slice(F.filter(parts, lambda p: F.length(p) > 20), 1, most)


def claim_list(reply: Column, answer: Column, most: int = 12) -> Column:
    """The claims that a model lists as JSON, with or without a fence, the first ``most``; the answer's sentences where its reply is no list."""
    bare = F.regexp_replace(strip(F.regexp_replace(reply, "```(?:json)?", "")), "^`+|`+$", "")
    listed = F.try_variant_get(F.try_parse_json(bare), "$", "array<variant>")
    return F.coalesce(F.slice(F.transform(listed, lambda c: F.try_variant_get(c, "$", "string")), 1, most), claims(answer))


# What a judge may say of a claim.
VERDICTS = ("SUPPORTED", "PARTIAL", "UNSUPPORTED", "FABRICATED")


def verdict(reply: Column) -> Column:
    """The verdict before the first bar; unknown ones count as unsupported."""
    v = F.upper(strip(F.split(reply, r"\|", 2)[0]))
    return F.when(v.isin(*VERDICTS), v).otherwise("UNSUPPORTED")


def repair_json(text: Column) -> Column:
    """The first of four readings that is JSON, as a string, or null.

    The whole text; a fenced block; from the first to the last brace; the same with trailing
    commas gone and single quotes doubled.
    """

    def valid(s: Column) -> Column:
        return F.when(F.try_parse_json(s).isNotNull(), s)

    def braces(s: Column) -> Column:
        a = F.instr(s, "{")
        b = F.length(s) - F.instr(F.reverse(s), "}") + 1
        return F.when((a > 0) & (F.instr(s, "}") > 0) & (b > a), F.substr(s, a, b - a + 1))

    fence = F.regexp_extract(text, r"(?s)```(?:json)?[\x09-\x0D\x20]*(\{.*?\})[\x09-\x0D\x20]*```", 1)
    fixed = F.translate(F.regexp_replace(text, r",[\x09-\x0D\x20]*([}\]])", "$1"), "'", '"')
    return F.coalesce(valid(strip(text)), valid(F.nullif(fence, F.lit(""))), valid(braces(text)), valid(braces(fixed)))


def inst_prompt(messages: Column) -> Column:
    """An instruction-tagged prompt; a system message opens the user's turn."""

    def step(s: Column, m: Column) -> Column:
        opened = s.endswith("\n\n")
        return (
            F.when(m.role == "system", F.concat(s, F.lit("[INST] "), m.content, F.lit("\n\n")))
            .when((m.role == "user") & opened, F.concat(s, m.content, F.lit(" [/INST]")))
            .when(m.role == "user", F.concat(s, F.lit("[INST] "), m.content, F.lit(" [/INST]")))
            .when(m.role == "assistant", F.concat(s, F.lit(" "), m.content, F.lit(" </s><s>")))
            .otherwise(s)
        )

    return F.aggregate(messages, F.lit("<s>"), step)
