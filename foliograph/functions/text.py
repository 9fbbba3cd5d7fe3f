"""Column expressions over texts: inline runs, folding, slugs, title norms. All built-in, so they stay in the plan."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "struct<text:string,bold:boolean,italic:boolean,sup:boolean,sub:boolean,math:boolean>"

# Vowels of Vietnamese by the letter that a slug has for them.
VOWELS = {"a": "àáạảãâầấậẩẫăằắặẳẵ", "e": "èéẹẻẽêềếệểễ", "i": "ìíịỉĩ", "o": "òóọỏõôồốộổỗơờớợởỡ", "u": "ùúụủũưừứựửữ", "y": "ỳýỵỷỹ", "d": "đ"}
# Inline patterns. One pass finds the leftmost span; earlier alternatives win.
LINK = r"\[([^\]]+)\]\([^)]*\)|\[\]\(([^)]*)\)"
MATH = r"(?s)\$\$(.+?)\$\$|\$(.+?)\$"
SPAN = (
    r"(?d)\*\*\*(.+?)\*\*\*|___(.+?)___|\*\*(.+?)\*\*|__(.+?)__|<sup>(.+?)</sup>|<sub>(.+?)</sub>"
    r"|\*(.+?)\*|(?<![A-Za-z0-9])_(.+?)_(?![A-Za-z0-9])"
)
SIZING = [("\\left[", "["), ("\\right]", "]"), ("\\left(", "("), ("\\right)", ")"), ("\\left\\{", "\\{"), ("\\right\\}", "\\}"), ("\\left|", "|"), ("\\right|", "|"), ("\\left.", ""), ("\\right.", "")]

# Marks that frame matches while a text is taken apart; they are removed from the text first.
_M, _S, _G = "\u0001", "\u0002", "\u0003"


#: What (?U)\s matches: the characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (any Unicode kind) at either end. Only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def single_spaces(c: Column) -> Column:
    """Each run of white space as one space; only runs that aren't one already are matched."""
    return F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " ")


def slugify(c: Column) -> Column:
    """Lower case, Vietnamese letters to ASCII, everything else to single inner dashes."""
    low = strip(F.lower(c))
    plain = F.translate(low, "".join(VOWELS.values()), "".join(k * len(v) for k, v in VOWELS.items()))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9-]", "-"), "-+", "-"), "^-|-$", "")


def _decomposing() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks whose canonical decomposition starts with a base letter, and those letters."""
    pairs = []
    for n in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(n))
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            pairs.append((chr(n), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _decomposing()


def fold_text(c: Column) -> Column:
    """Lower case without combining marks; letters that don't decompose (đ, ß, ø) stay. ASCII texts, of as many bytes as characters, have neither."""
    low = F.lower(c)
    return F.when(F.octet_length(c) == F.char_length(c), low).otherwise(F.regexp_replace(F.translate(low, _FROM, _TO), r"\p{Mn}", ""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def normalize_formula(c: Column) -> Column:
    for old, new in SIZING:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def table_cells(line: Column) -> Column:
    """Trimmed cells of a table row, outer bars dropped."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), strip)


def _run(text: Column, bold: Column, italic: Column, sup: bool | Column = False, sub: bool | Column = False, math: bool = False) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(text.alias("text"), bold.alias("bold"), italic.alias("italic"), as_col(sup).alias("sup"), as_col(sub).alias("sub"), F.lit(math).alias("math"))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda's argument is, an expression that is used twice isn't."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def resolve_links(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{_M}{_S}{_G}]", ""), LINK, "$1$2")


def tokenize_runs(text: Column, bold: bool = False, italic: bool = False) -> Column:
    """Styled runs of a text: links become their visible text, then math is cut out, then emphasis in the order of SPAN; equal neighbours merge. A text without a character that any of these begins with is one run."""
    b, i = F.lit(bold), F.lit(italic)
    linked = resolve_links(text)

    def prose(piece: Column) -> Column:
        framed = F.regexp_replace(piece, SPAN, _S + _G.join(f"${n}" for n in range(1, 9)) + _S)

        def styled(g: Column) -> Column:
            inner = F.array_join(g, "")
            has = lambda *ns: F.exists(F.array(*[F.get(g, F.lit(k - 1)) for k in ns]), lambda x: x != "")
            return _run(inner, F.when(has(1, 2, 3, 4), True).otherwise(b), F.when(has(1, 2, 7, 8), True).otherwise(i), has(5), has(6))

        def part(p: Column, n: Column) -> Column:
            return F.when(n % 2 == 0, _run(p, b, i)).otherwise(_let(F.split(p, _G, -1), styled))

        return F.transform(F.split(framed, _S, -1), part)

    pieces = F.split(F.regexp_replace(linked, MATH, f"{_M}$1$2{_M}"), _M, -1)
    runs = F.flatten(F.transform(pieces, lambda p, n: F.when(n % 2 == 1, F.array(_run(p, F.lit(False), F.lit(False), math=True))).otherwise(prose(p))))

    def merge(acc: Column, r: Column) -> Column:
        same = (F.size(acc) > 0) & ~r["math"] & ~F.try_element_at(acc, F.lit(-1))["math"]
        same = same & (F.struct(*[F.try_element_at(acc, F.lit(-1))[k] for k in ("bold", "italic", "sup", "sub")]) == F.struct(*[r[k] for k in ("bold", "italic", "sup", "sub")]))
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        joined = F.struct(F.concat(F.try_element_at(acc, F.lit(-1))["text"], r["text"]).alias("text"), *[r[k].alias(k) for k in ("bold", "italic", "sup", "sub", "math")])
        return F.when(same, F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    kept = F.filter(runs, lambda r: r["text"] != "").cast(f"array<{RUN}>")
    whole = F.array(_run(linked, b, i)).cast(f"array<{RUN}>")
    merged = _let(kept, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.array().cast(f"array<{RUN}>"), merge)).otherwise(whole))
    plain = ~text.rlike(rf"[\[$*_<{_M}{_S}{_G}]")
    return F.when(plain, F.array(_run(text, b, i)).cast(f"array<{RUN}>")).when(text.isNotNull(), merged)


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def strip_inline(text: Column) -> Column:
    return runs_text(tokenize_runs(text))


def norm_title(c: Column) -> Column:
    """Trimmed lower case without dotted leaders, single spaces, no outer ' :-'."""
    low = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), "[.…]+", "")
    return F.regexp_replace(single_spaces(low), "^[ :-]+|[ :-]+$", "")


def is_placeholder(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    marks = (r"[.…]{3,}", r"_{3,}", r"(?d)\{\{.*?\}\}", r"^(?U:\s*)\[[^\]]*\](?U:\s*)$", r"(?iU)\bx{3,}\b", r"(?i)lorem ipsum", "…")
    out = F.lit(False)
    for m in marks:
        out = out | t.rlike(m)
    return (t != "") & out


def norm_style(c: Column) -> Column:
    """'heading 1' to 'Heading1': each run of letters starts with a capital, spaces go."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.replace(F.array_join(F.transform(parts, F.initcap), ""), F.lit(" "), F.lit(""))


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams (with repeats) of the folded words, each padded with a space on both sides."""
    words = F.transform(F.regexp_extract_all(fold_text(c), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])

    def grams(word: Column) -> Column:
        fits = F.filter(sizes, lambda n: n <= F.length(word))
        return F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda at: F.substr(word, at, n))))

    return F.flatten(F.transform(words, grams))


def lcp_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    ahead = F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1))))
    return F.when(n == 0, F.lit(0)).when(F.size(ahead) == 0, n).otherwise(F.get(ahead, F.lit(0)) - 1)
