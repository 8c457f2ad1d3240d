"""Tokenizers as Catalyst expressions: string column in, array column out. NULL in, NULL out."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, in the words of Java and of RE2.
_BLANKS = r"\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CLASS = r"[\p{L}\p{M}\p{N}_]"
_TWEET = (
    r"https?://[^\s]+|www\.[^\s]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d+\.\d+|[#@]?[\p{L}\p{M}\p{N}_]+(?:'[\p{L}\p{M}\p{N}_]+)?"
    r"|[:;=8][\-o*']?[)\](\[dDpP/:}{@|\\]|[)\](\[dDpP/:}{@|\\][\-o*']?[:;=8]|\S"
)
_LEXER = (
    r"(?:n't|'(?:ll|re|ve|m|d|s))|--|[,.;:?!]+|[(){}\[\]<>]"
    r"|[A-Za-zÀ-ÿ0-9]+(?:[-'][A-Za-zÀ-ÿ0-9]+)*|[^ \t\n\f]"
)


def _present(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def sentences(text: Column) -> Column:
    """Cut at one space after . ! or ?; an empty last piece is dropped."""
    parts = F.split(text, r"(?<=[.!?]) ", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def sentences_without_model(text: Column) -> Column:
    """A boundary between . ! ? and white space or a quote; white space after it is skipped, a blank tail dropped."""
    parts = F.split(text, r"(?<=[.!?])(?=[ \n\"'])\s*", -1)
    return F.filter(parts, lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")


def space(text: Column) -> Column:
    """T5: cut at each space, empty tokens are kept."""
    return F.split(text, " ", -1)


def tab(text: Column) -> Column:
    """Cut at each tab, empty tokens are kept."""
    return F.split(text, "\t", -1)


def lines(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(text, "\r?\n", -1), lambda x: F.trim(x) != "")


def blank_lines(text: Column) -> Column:
    """Paragraphs between empty lines, trimmed."""
    return _present(F.transform(F.split(text, "\n\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))


def chars(text: Column) -> Column:
    """One token for each code point."""
    return _present(F.split(text, "", -1))


def whitespace(text: Column) -> Column:
    """Cut at runs of Unicode white space."""
    inner = F.regexp_replace(text, rf"^[{_BLANKS}]+|[{_BLANKS}]+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{_BLANKS}]+", -1))


def word_punct(text: Column) -> Column:
    """Runs of word characters, and runs of characters that are neither word nor white space."""
    return F.regexp_extract_all(text, F.lit(rf"({WORD_CLASS}+|[^\p{{L}}\p{{M}}\p{{N}}_\s]+)"), F.lit(1))


def regexp(text: Column, pattern: str = r"\w+", gaps: bool = False, flags: int | None = None) -> Column:
    """The matches of a pattern, or with gaps what lies between them, without empty tokens. flags: see ``flagged``; by
    default the pattern is Java's."""
    if flags is not None:
        pattern = flagged(pattern, flags)
    if gaps:
        return _present(F.split(text, pattern, -1))
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_CLASS}+)"), F.lit(1))


def tweet(text: Column, preserve_case: bool = True, reduce_len: bool = False, strip_handles: bool = False) -> Column:
    """URLs, addresses, tags, emoticons, words; optionally lower case, runs cut to three, handles dropped."""
    tokens = F.regexp_extract_all(text, F.lit(f"({_TWEET})"), F.lit(1))
    if strip_handles:
        tokens = F.filter(tokens, lambda x: ~(x.startswith("@") & (F.length(x) > 1)))
    if not preserve_case:
        tokens = F.transform(tokens, F.lower)
    if reduce_len:
        tokens = F.transform(tokens, lambda x: F.regexp_replace(x, r"(.)\1{3,}", "$1$1$1"))
    return tokens


def lexer_words(text: Column) -> Column:
    """Longest matches of contractions, dashes, punctuation runs, brackets and words; any other character alone."""
    return F.regexp_extract_all(text, F.lit(f"({_LEXER})"), F.lit(1))


_NO_SPACE_BEFORE = [".", ",", "!", "?", ":", ";", ")", "]", "}", "%", "''", "n't", "(", "[", "{", "``"]


def detokenize(tokens: Column) -> Column:
    """Tokens joined by spaces, but none before closing and opening punctuation and clitics."""
    tight = lambda x: x.isin(_NO_SPACE_BEFORE) | x.startswith("'")
    joined = F.array_join(F.transform(tokens, lambda x: F.when(tight(x), x).otherwise(F.concat(F.lit(" "), x))), "")
    return F.when(tight(F.get(tokens, F.lit(0))), joined).otherwise(F.substring(joined, 2, 1 << 30))


def _category(kind: str, without: str = "", more: str = "") -> str:
    """A character class: a Unicode category of the basic plane without those listed in hex, and some more."""
    drop = {int(c, 16) for c in without.split()}
    codes = [c for c in range(0x10000) if unicodedata.category(chr(c)) == kind and c not in drop] + [int(c, 16) for c in more.split()]
    return "".join(f"\\x{{{c:x}}}" for c in codes)


_OPEN = _category("Ps", "f3a f3c 169b 2308 230a 2768 276a 276c 276e 2770 2772 2774 27c5 2e42 2e55 2e57 2e59 2e5b fd3f fe35 fe37 fe39 fe3b fe3d fe3f fe41 fe43 fe47")
_CLOSE = _category("Pe", "169c 2309 230b 2769 276b 276d 276f 2771 2773 2775 27c6 2e56 2e58 2e5a 2e5c 301f fd3e", "2a00")
_CURRENCY = _category("Sc", "7fe 7ff 20bb 20bc 20bd 20be 20bf 20c0")
_ALONE = r",;!\x{22}\])}%\x{60c}\x{61b}\x{61f}\x{66a}\x{a1}\x{a9}\x{ae}\x{b0}\x{b1}\x{bb}\x{bf}\x{203a}\x{201d}\x{2026}\x{964}\x{965}" + r"({\[\x{ab}\x{2018}\x{2019}\x{201a}\x{201c}\x{201e}\x{2039}\x{300c}\x{300e}\x{2013}\x{2014}"
#: Ordered substitutions; \1 is the first group. Single characters that only get spaces share one substitution.
TOKTOK = [
    (r"(\p{Nd}),(\p{Nd})", "\\1\x01\\2"), (r"\x{a0}", " "), (f"([{_ALONE}])", " \\1 "), ("& ", "&amp; "), ("\t", " &#9; "), (r"\|", " &#124; "), (r"([\x{27}\x{2019}`])", " \\1 "), (" ` ` ", " `` "), (" ' ' ", " '' "),
    (r"(?m)\.$", " ."), (rf"(?m)\.[{_BLANKS}]*([\x{{22}}\x{{27}}\x{{2019}}\x{{bb}}\x{{203a}}\x{{201d}}])[{_BLANKS}]*$", " . \\1"), (r"(?m)\?$", " ?"), (r"(,{2,}|-{2,}|\.{2,})", " \\1 "), (f"([{_OPEN}{_CURRENCY}])", "\\1 "), (f"([{_CLOSE}])", " \\1"),
]


def _java(pattern: str) -> str:
    """A substitution's pattern in Java's words. A class of Java tries its members above U+00FF one after another: a character up
    to there is looked up among the others alone."""
    pattern = pattern.replace("(?m)", "(?md)")
    for big in (_OPEN + _CURRENCY, _CLOSE, _ALONE):
        if pattern == f"([{big}])":
            return f"([\\x{{0}}-\\x{{ff}}&&[{_part(big, False)}]]|(?![\\x{{0}}-\\x{{ff}}])[{_part(big, True)}])"
    return pattern


def _part(members: str, above: bool) -> str:
    """The members of a class of single characters that lie above U+00FF, or those up to there."""
    codes = [int(m[1], 16) if m[1] else ord(m[0][-1]) for m in re.finditer(r"\\x\{([0-9a-f]+)\}|\\.|.", members)]
    return "".join(f"\\x{{{c:x}}}" for c in codes if (c > 0xFF) == above)


def toktok_text(text: Column) -> Column:
    """T18 with return_str: the text with spaces between its tokens; commas within numbers are U+0001."""
    for pattern, to in TOKTOK:
        text = F.regexp_replace(text, _java(pattern), to.replace("\\", "$"))
    return F.regexp_replace(F.regexp_replace(text, " {2,}", " "), rf"^[{_BLANKS}]+|[{_BLANKS}]+$", "")


def toktok(text: Column) -> Column:
    """Ordered substitutions that set off punctuation, brackets, quotes, dashes and currency signs; commas within numbers stay."""
    parts = _present(F.split(toktok_text(text), rf"[{_BLANKS}]+", -1))
    return F.transform(parts, lambda x: F.replace(x, F.lit("\x01"), F.lit(",")))


def flagged(pattern: str, flags: int = 0) -> str:
    """A pattern with the flag bits I 2, M 8, S 16, X 64 written into it; without ASCII 256, classes are Unicode."""
    inline = "".join(c for bit, c in ((2, "i"), (8, "m"), (16, "s"), (64, "x")) if flags & bit) + ("" if flags & 256 else "U")
    return f"(?{inline}){pattern}" if inline else pattern


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams; none of shorter arrays. tokens: a plain column; an expression would be evaluated for each n-gram."""
    if n == 2:
        return F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.array(a, b))
    count = F.size(tokens) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(tokens, i, n))).otherwise(F.slice(F.array(tokens), 1, 0))


def ngram_structs(tokens: Column, n: int, *names: str) -> Column:
    """As ``ngrams``, of structs with these fields: made without a lambda, for tables of n-grams."""
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    return F.arrays_zip(*[F.slice(tokens, i + 1, count).alias(name) for i, name in enumerate(names)])


def everygrams(tokens: Column, shortest: int, longest: int) -> Column:
    """The n-grams of all lengths from shortest to longest."""
    out = ngrams(tokens, shortest)
    for n in range(shortest + 1, longest + 1):
        out = F.concat(out, ngrams(tokens, n))
    return out


def pad(tokens: Column, n: int, left: str = "<s>", right: str = "</s>") -> Column:
    """N - 1 marks at both ends."""
    return F.concat(F.array_repeat(F.lit(left), n - 1), tokens, F.array_repeat(F.lit(right), n - 1))


def blank(text: Column) -> Column:
    """No character but white space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", "")) == ""


def collapsed(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def count_char(text: Column, char: str) -> Column:
    """S18."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def log_base2(score: Column) -> Column:
    """Minus infinity at 0."""
    return F.when(score == 0, F.lit(float("-inf"))).otherwise(F.log2(score))
