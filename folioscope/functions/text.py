"""Text scalars as Column expressions: tokens, categories, ratios, repetition, quality flags."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand without a backslash, and the members of the token categories that a rule cannot tell.
ENVIRONMENT_NAMES = "matrix pmatrix bmatrix Bmatrix vmatrix Vmatrix array cases rcases align aligned align* eqnarray tabular".split()
GREEK = (
    r"\alpha \beta \gamma \delta \epsilon \zeta \eta \theta \iota \kappa \lambda \mu \nu \xi \pi \rho \sigma \tau \upsilon \phi \chi \psi \omega "
    r"\Gamma \Delta \Theta \Lambda \Xi \Pi \Sigma \Upsilon \Phi \Psi \Omega \varepsilon \vartheta \varpi \varrho \varsigma \varphi"
).split()
RELATIONS = (
    r"+ - = > < * / \times \cdot \div \cap \cup \neq \leq \geq \le \ge \in \notin \subset \supset \subseteq \supseteq \subsetneqq \subsetneq \supsetneqq \supsetneq "
    r"\simeq \approx \equiv \cong \ne \wedge \vee \land \lor \perp \parallel \oplus \otimes \boxtimes \Box \square \star \sqcup \sqcap \odot \backsim \bot \top "
    r"\propto \mathrel \mathop \sim \geqslant \leqslant \neg \cancel \bcancel \pm \mp \gt \lt"
).split()
STRUCTURAL = (
    r"^ _ { } \binom \frac \cfrac \tfrac \dfrac \begin \end \hat \widehat \vec \bar \underline \overbrace \underbrace \overline \overset \stackrel \text \mathrm \textstyle "
    r"\operatorname \mathbb \mathcal \mathbf \rotatebox \Bigg \textcircled \boxed \mathring \dot \ddots \substack \sqrt \sum \int \iint \iiint \iiiint \oint \lim \limsup \liminf \limits"
).split() + ENVIRONMENT_NAMES
GROUPING = r"( ) [ ] \left \right \( \) \[ \] \{ \} \langle \rangle \| | \lvert \rvert \lceil \rceil \lbrace \rbrace \lfloor \rfloor '' \_ \# \%".split()
PUNCTUATION = list(",:.;!?'\"、。")
LAYOUT = ["\\\\", "&", "\\"]
#: The eleven categories in the order of all reports.
CATEGORIES = (
    "english tokens", "digit tokens", "greek tokens", "special symbol tokens", "operator tokens", "grouping tokens", "structural tokens", "CJK tokens", "punctuation tokens", "layout / alignment tokens",
    "other / unknown tokens",
)
STRUCTURE_TRIGGERS = {
    "frac": [r"\frac", r"\cfrac", r"\tfrac", r"\dfrac", r"\binom"], "sup": ["^"], "sub": ["_"], "sqrt": [r"\sqrt"], "env": [r"\begin"],
    "bigop": [r"\sum", r"\int", r"\iint", r"\iiint", r"\iiiint", r"\oint", r"\lim", r"\limsup", r"\liminf"], "accent": [r"\hat", r"\widehat", r"\vec", r"\bar", r"\underline", r"\overline", r"\overbrace", r"\underbrace", r"\mathring", r"\dot"],
    "stackrel": [r"\stackrel", r"\overset", r"\substack"], "textcircled": [r"\textcircled"],
}
CONFUSABLE = {
    "digit-letter": [["1", "l"], ["2", "z"], ["5", "s"], ["6", "b"], ["9", "g", "q"]], "circle-like": [["0", "o"], [r"\theta"]], "latin-greek": [["p", r"\rho"], ["u", r"\mu"]],
    "greek-variant": [["4", r"\varphi"]], "operator-variable": [["x", r"\times"]], "relation-stroke": [["<", r"\leq", r"\le"], [">", r"\geq", r"\ge"]],
}
SIMILAR = {
    "1_l": "1 l", "2_z": "2 z", "5_s": "5 s", "6_b": "6 b", "9_g_q": "9 g q", "0_o_theta": r"0 o \theta", "p_rho": r"p \rho", "u_mu": r"u \mu", "4_varphi": r"4 \varphi", "x_times": r"x \times",
    "lt_leq": r"< \leq", "gt_geq": r"> \geq",
}
LENGTH_BINS = [("1-10 tokens", 1, 10), ("11-20 tokens", 11, 20), ("21-40 tokens", 21, 40), ("41-80 tokens", 41, 80), ("> 80 tokens", 81, None)]
# end of fixed values

#: By rule: a command is a backslash and letters, or a backslash and one more character; environment names stand as they are.
TOKEN_RULE = r"\\[A-Za-z]+|\\[^A-Za-z\s]|" + "|".join(re.escape(x) for x in sorted(ENVIRONMENT_NAMES, key=len, reverse=True)) + r"|\S"


#: Longer entries of a vocabulary are never matched.
LONGEST = 32


def token_pattern(vocabulary: Iterable[str] | None = None) -> str:
    """The tokenizer's pattern; with a vocabulary, its longest entry of at most LONGEST characters at each place, else one character."""
    if vocabulary is None:
        return TOKEN_RULE
    return "|".join(re.escape(x) for x in sorted({x for x in vocabulary if 0 < len(x) <= LONGEST}, key=lambda x: (-len(x), x))) + r"|\S"


def tokens(text: Column, vocabulary: Iterable[str] | None = None) -> Column:
    """array<string> of the text's tokens; empty for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({token_pattern(vocabulary)})"), 1), F.array().cast("array<string>"))


#: White space of one byte.
BLANK = " \t\n\x0b\f\r"


def normalized(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(BLANK))


def category(token: Column) -> Column:
    """One of CATEGORIES."""
    return (
        F.when(token.rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]$"), "CJK tokens")
        .when(token.rlike(r"^\p{Nd}$"), "digit tokens").when(token.rlike("^[A-Za-z]$"), "english tokens")
        .when(token.isin(LAYOUT), "layout / alignment tokens").when(token.isin(PUNCTUATION), "punctuation tokens")
        .when(token.isin(GREEK), "greek tokens").when(token.isin(GROUPING), "grouping tokens").when(token.isin(STRUCTURAL), "structural tokens").when(token.isin(RELATIONS), "operator tokens")
        .when(token.rlike(r"^\\[A-Za-z]+$") | token.isin("√"), "special symbol tokens").otherwise("other / unknown tokens")
    )


def content_kind(array: Column) -> Column:
    """Whether tokens are CJK only, without CJK, or mixed; without tokens as without CJK."""
    cjk = lambda t: t.rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]$")
    some, other = F.exists(array, cjk), F.exists(array, lambda t: ~cjk(t))
    return F.when(some & other, "mixed").when(some, "text").otherwise("latex")


def binned(value: Column, bins: list[tuple]) -> Column:
    """Label of the closed integer bin (label, low, high or None); null outside."""
    out = None
    for label, low, high in bins:
        hit = value >= low if high is None else value.between(low, high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def half_open(value: Column, bins: list[tuple], first_below: bool = False) -> Column:
    """Label of the bin [low, high); above all the last; with first_below what isn't positive is in the first."""
    out = F.when(value <= 0, bins[0][0]) if first_below else None
    for label, low, high in bins:
        hit = (value >= low) & (value < high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(bins[-1][0])


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def count_of(text: Column, characters: str) -> Column:
    """How many of the text's characters are among these; one pass without a pattern."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def char_ratios(text: Column) -> dict[str, Column]:
    """Shares of character classes among characters that aren't white space; white space among all."""
    visible = F.length(F.translate(text, BLANK, ""))
    share = lambda part: ratio(part.cast("double"), visible)
    return {
        "chinese_ratio": share(F.regexp_count(text, F.lit("[\\x{4E00}-\\x{9FFF}]"))), "latin_ratio": share(count_of(text, "".join(chr(c) for c in (*range(65, 91), *range(97, 123))))), "digit_ratio": share(count_of(text, "0123456789")),
        "operator_ratio": share(count_of(text, "-+*/=<>^_")), "bracket_ratio": share(count_of(text, "[](){}")), "punct_ratio": share(count_of(text, ".,;:!?")), "whitespace_ratio": ratio(count_of(text, BLANK).cast("double"), F.length(text)),
    }


def _grams(text: Column, size: int, step: int) -> Column:
    """n-grams at every step-th character, from pieces of one step: linear in the text, unlike cutting each gram out of it."""
    pieces = F.regexp_extract_all(text, F.lit(f"((?s).{{{step}}})"), 1)
    if size == step:
        return pieces
    return F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.concat(F.get(p, i), F.get(p, i + 1)))).otherwise(F.array().cast("array<string>")))[0]


def _top_count(grams: Column) -> Column:
    """Count of the most frequent element: the longest run of the sorted array."""
    step = lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1)).alias("run"), F.greatest(s["best"], F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1))).alias("best"))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(F.sort_array(grams), start, step, lambda s: s["best"])


def repetition_ratio(text: Column, size: int = 8) -> Column:
    """Share of the text that its most frequent non-overlapping n-gram makes up; 0 for texts under two n-grams or without a repeat."""
    top = _top_count(_grams(text, size, size))
    return F.when((F.length(text) < 2 * size) | (top <= 1), 0.0).otherwise(top * size / F.length(text))


def max_ngram_repeat(text: Column, size: int = 12) -> Column:
    """Count of the most frequent n-gram at half-overlapping places; 0 for texts under three n-grams."""
    return F.when(F.length(text) < 3 * size, 0).otherwise(_top_count(_grams(text, size, size // 2)))


def invalid_char_rate(text: Column) -> Column:
    """Share of replacement and control characters."""
    return ratio(F.regexp_count(text, F.lit("[\\x{FFFD}\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}]")).cast("double"), F.length(text))


def math_counts(text: Column) -> dict[str, Column]:
    """Occurrences of eight formula marks."""
    marks = {"n_equals": "=", "n_frac": r"\\frac", "n_sqrt": r"\\sqrt", "n_sub": "_", "n_sup": r"\^", "n_vec": r"\\vec", "n_angle": r"\\angle", "n_env": r"\\begin"}
    return {k: F.regexp_count(text, F.lit(v)).cast("long") for k, v in marks.items()}


def is_formula_line(line: Column) -> Column:
    return line.rlike(r"^\s*(\$\$|\\\[|\\\()") | (line.contains("$") & line.rlike(r"[=+<>^_\\]"))


def brace_balance(array: Column) -> Column:
    """Opening less closing braces."""
    return F.size(F.filter(array, lambda t: t == "{")) - F.size(F.filter(array, lambda t: t == "}"))


def has_delete_marker(text: Column, array: Column) -> Column:
    marks = [r"\delete", r"\ddelete", r"\deleted"]
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, marks))), F.lit(False)) | text.contains(marks[0]) | text.contains(marks[1])


def exclusion_reason(raw: Column, clean: Column, array: Column) -> Column:
    """Why an expression is not valid, or an empty string."""
    return F.when(raw.isNull() | (raw == ""), "empty_annotation").when(clean == "", "empty_after_normalization").when(F.size(array) == 0, "empty_after_tokenization").otherwise("")


def quality_status(text: Column, repetition: float = 0.35, repeats: int = 20, invalid: float = 0.05, max_chars: int = 20_000) -> Column:
    """The first that holds of empty, truncated, repetitive, suspicious; else valid."""
    return (
        F.when(text.isNull() | (normalized(text) == ""), "empty").when(F.length(text) >= max_chars, "truncated")
        .when((repetition_ratio(text) >= repetition) | (max_ngram_repeat(text) >= repeats), "repetitive").when(invalid_char_rate(text) >= invalid, "suspicious").otherwise("valid")
    )


def clean_ocr_text(text: Column) -> Column:
    """Without grounding tags and control characters; newlines unified, three or more made two, ends stripped."""
    out = F.regexp_replace(text, r"(?s)<\|ref\|>.*?<\|/ref\|>|(?s)<\|det\|>.*?<\|/det\|>", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}]", "")
    return normalized(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def prefix_key(name: Column) -> Column:
    """A name up to its first underscore; the name itself without one."""
    return F.substring_index(name, "_", 1)


def page_id(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(jpg|json)$", "")
