"""Text functions as column builders: masking, normal forms, snippets, hashes. No Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 white-space code points that search ignores.
SPACE_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# Initial consonants of Hangul syllables in Unicode order.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
#: Syllables for one initial (21 vowels times 28 finals).
PER_INITIAL = 588
#: Pieces of text whose lengths are summed at once.
BLOCK = 64
# Korean particles that search strips from the end of a word.
PARTICLES = (
    "에서는", "에게는", "으로는", "에서도",
    "에서", "으로", "에게", "까지", "부터", "보다", "처럼", "에는", "에도", "로는", "이나",
    "을", "를", "이", "가", "은", "는", "의", "에", "로",
    "과", "와", "도", "만", "나",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty(c: Column | str) -> Column:
    """Null and blank both mean unknown."""
    return F.coalesce(F.trim(col(c)), F.lit("")) == ""


def nonblank(c: Column | str) -> Column:
    """Trimmed text, null where unknown."""
    return F.nullif(F.trim(col(c)), F.lit(""))


#: A digit of any script, and white space as a separator.
_DIGIT, _GAP = r"\p{Nd}", SPACE_CLASS[1:-1]


def _where(c: Column, cheap: Column, then: Column) -> Column:
    """``then`` only where a cheap test says that it can change the text."""
    return F.when(cheap, then).otherwise(c)


def mask_phone(c: Column | str) -> Column:
    """Mobile numbers keep their prefix and last four digits.

    No digit or hyphen may stand before one and no digit after it; parts are joined by nothing or by
    one of ``-``, ``.``, white space and, after the prefix, ``)``.
    """
    pattern = rf"(?<![{_DIGIT}-])(01[016789])[-.){_GAP}]?{_DIGIT}{{3,4}}[-.{_GAP}]?({_DIGIT}{{4}})(?!{_DIGIT})"
    return _where(col(c), col(c).contains("01"), F.regexp_replace(col(c), pattern, "$1-****-$2"))


def mask_resident_number(c: Column | str) -> Column:
    """Six digits, a separator or none, and seven digits of which the first, 1 to 4, stays."""
    pattern = rf"(?<![{_DIGIT}-])({_DIGIT}{{6}})[-.{_GAP}]?([1-4]){_DIGIT}{{6}}(?!{_DIGIT})"
    return F.regexp_replace(col(c), pattern, "$1-$2******")


#: Two code points that no text uses, around a local part that is to be masked.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def mask_email(c: Column | str) -> Column:
    """One or two characters before the sign leave the first; more leave two."""
    local, domain = "[A-Za-z0-9._%+-]", r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    text = F.regexp_replace(col(c), f"(?<!{local})({local}++)@({domain})(?![A-Za-z0-9-])", f"{_OPEN}$1{_CLOSE}@$2")
    text = F.regexp_replace(text, f"{_OPEN}(.).?{_CLOSE}", "$1*")
    return _where(col(c), col(c).contains("@"), F.regexp_replace(text, f"{_OPEN}(..).+?{_CLOSE}", "$1***"))


def mask_pii(c: Column | str) -> Column:
    """Phone numbers, resident numbers and e-mail addresses masked; null becomes empty."""
    return mask_email(mask_resident_number(mask_phone(F.coalesce(col(c), F.lit("")))))


def nospace_lower(c: Column | str) -> Column:
    """Lower-case text without white space, the form that search compares."""
    text = F.coalesce(col(c), F.lit(""))
    for common in (" ", "\n"):
        text = F.replace(text, F.lit(common), F.lit(""))
    return F.lower(F.regexp_replace(text, SPACE_CLASS, ""))


def clean_term(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)[^\w가-힣ㄱ-ㅎ]", "")


def strip_suffix(c: Column | str, suffixes: list[str] | tuple[str, ...] = PARTICLES) -> Column:
    """Without its longest suffix, if the word is longer than two and two characters stay."""
    longest = "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))
    return F.regexp_replace(col(c), f"^(.{{2,}}?)(?:{longest})$", "$1")


def choseong(c: Column | str, spaces: bool = False) -> Column:
    """Initial consonants of Hangul syllables; other characters stay, white space too if ``spaces``."""
    syllables = "".join(chr(0xAC00 + i) for i in range(len(INITIALS) * PER_INITIAL))
    initials = "".join(x * PER_INITIAL for x in INITIALS)
    text = F.lower(col(c)) if spaces else nospace_lower(c)
    return F.translate(text, syllables, initials)


def hybrid_pattern(term: str) -> str:
    """Regular expression of a mixed syllable and initial term: each initial stands for its syllables."""
    out = "(?i)"
    for x in term:
        i = INITIALS.find(x)
        if i >= 0:
            first = 0xAC00 + i * PER_INITIAL
            out += f"[{x}{chr(first)}-{chr(first + PER_INITIAL - 1)}]"
        else:
            out += "\\Q" + x + "\\E"
    return out


def cell_text(c: Column | str, limit: int = 30_000, notice: str = "…(truncated)") -> Column:
    """Tags to spaces, at most one empty line in a row, trimmed, cut with a notice."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " "), "\n{3,}", "\n\n"))
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(notice))).otherwise(text)


def without_controls(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def csv_cell(c: Column | str, limit: int = 1000) -> Column:
    """Cut, and guarded against cells that a spreadsheet would run as a formula."""
    text = F.left(F.coalesce(col(c), F.lit("")), F.lit(limit))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


_SOURCE = r"^\x{FEFF}?<!--\s*source:\s*(.*?)\s*-->[ \t]*\r?\n?"


def source_header(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), _SOURCE, 1), F.lit(""))


def strip_source_header(c: Column | str) -> Column:
    return F.regexp_replace(col(c), _SOURCE, "")


def preview(c: Column | str, limit: int = 1500) -> Column:
    """Start of a body without comments, tags, heading marks, table rules, pipes and emphasis."""
    text = F.left(F.coalesce(col(c), F.lit("")), F.lit(limit))
    for pattern, to in ((r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "), (r"(?m)^#+\s*", ""), (r"(?m)^\s*\|?[\s:|-]{3,}\|?\s*$", " "), (r"\|", " "), (r"[*_`]+", ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def requester_stem(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(col(c)), r"\s*(의원|처|실|팀|관)?$", ""))


def digits(c: Column | str) -> Column:
    """Digits alone, without leading zeros."""
    return F.ltrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\D", ""), F.lit("0"))


def is_image_only(c: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"!\[[^\]]*\]\([^)]*\)", ""), r"<[^>]+>|\s", "")
    return F.length(bare) < 40


def content_hash(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(col(c), F.lit("")), 256))


def snippet(c: Column | str, needles: list[str], around: int = 60, fallback: int = 120) -> Column:
    """Text around the first needle, in their order, that occurs; else the start."""
    text = F.coalesce(col(c), F.lit(""))
    low = F.lower(text)
    hits = [F.when(F.instr(low, n.lower()) > 0, F.struct(F.instr(low, n.lower()).alias("at"), F.lit(len(n)).alias("n"))) for n in needles if n]
    if not hits:
        return F.left(text, F.lit(fallback))
    hit = F.coalesce(*hits)
    start = F.greatest(hit["at"] - around, F.lit(1))
    end = F.least(hit["at"] + hit["n"] - 1 + around, F.length(text))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(hit.isNull(), F.left(text, F.lit(fallback))).otherwise(cut)


def agent_snippet(c: Column | str, query: str, limit: int = 300, around: int = 60) -> Column:
    """struct(snippet, start, end, truncated): text around the first query word of two characters or more that occurs.

    The snippet is stripped and has an ellipsis where text is left out. Without a hit it is the start of the
    text. start and end are the range it covers; a snippet without a hit or cut at ``limit`` has none.
    """
    text = F.coalesce(col(c), F.lit(""))
    low, long = F.lower(text), F.length(text)
    strip = lambda x: F.regexp_replace(x, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    words = [w for w in query.split() if len(w) >= 2]
    hits = [F.when(F.instr(low, w.lower()) > 0, F.struct(F.instr(low, w.lower()).alias("at"), F.lit(len(w)).alias("n"))) for w in words]
    hit = F.coalesce(*hits) if hits else F.lit(None).cast("struct<at:int,n:int>")
    start = F.greatest(hit["at"] - 1 - around, F.lit(0))
    end = F.least(hit["at"] - 1 + hit["n"] + around, long)
    head = strip(F.left(text, F.lit(limit)))
    part = F.concat(F.when(start > 0, "…").otherwise(""), strip(F.substring(text, start + 1, end - start)), F.when(end < long, "…").otherwise(""))
    fits = hit.isNotNull() & (F.length(part) <= limit)
    body = F.when(hit.isNull(), F.concat(head, F.when(long > F.length(head), "…").otherwise(""))).when(fits, part).otherwise(F.concat(F.left(part, F.lit(limit)), F.lit("…")))
    truncated = F.when(hit.isNull(), long > F.length(head)).when(fits, end < long).otherwise(True)
    covered = F.least(end, start + F.length(part))
    return F.struct(body.alias("snippet"), F.when(fits, start).alias("start"), F.when(fits, covered).alias("end"), truncated.alias("truncated"))


def earliest_snippet(c: Column | str, tokens: list[str], before: int = 40, after: int = 100) -> Column:
    """Text around the earliest of all tokens; where none occurs, of all tokens with white space between characters."""
    text = F.coalesce(col(c), F.lit(""))
    loose = "(?i)" + "|".join(r"\s*".join("\\Q" + x + "\\E" for x in t) for t in tokens if 2 <= len(t) <= 30)
    at = F.array_min(F.filter(F.array(*[F.instr(F.lower(text), t.lower()) for t in tokens]), lambda x: x > 0))
    if loose != "(?i)":
        at = F.coalesce(at, F.nullif(F.regexp_instr(text, F.lit(loose)), F.lit(0)))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at.isNull(), F.left(text, F.lit(before + after))).otherwise(F.substring(text, start, at + after - start))


def match_positions(c: Column | str, needle: str) -> Column:
    """Start offsets of the needle, from 0, not overlapping, case ignored."""
    size = len(needle)
    parts = F.split(F.lower(F.coalesce(col(c), F.lit(""))), "\\Q" + needle.lower() + "\\E")
    pieces = F.transform(parts, lambda p: F.length(p) + size)

    def starts(lengths: Column) -> Column:
        # running sums block by block, so that the work is not the square of the number of hits
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        last = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
        sums = F.transform(blocks, total)
        inner = lambda a, base: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: base + total(F.slice(a, F.lit(1), i)))
        return F.flatten(F.transform(blocks, lambda a, b: inner(a, total(F.slice(sums, F.lit(1), b)))))

    every = F.transform(F.array(pieces), starts)[0]
    return F.transform(F.slice(every, F.lit(1), F.size(every) - 1), lambda x: x - size)


def highlight_terms(query: str) -> list[str]:
    """Phrases and words of two characters or more, without exclusions, OR, qualifiers and initials."""
    phrases = [p.strip() for p in re.findall(r'"([^"]*)"', query) if p.strip()]
    words = re.sub(r'"[^"]*"', " ", query).replace("|", " ").split()
    keep = [w for w in words if len(w) >= 2 and not w.startswith("-") and w.upper() != "OR" and ":" not in w and not re.fullmatch("[ㄱ-ㅎ]+", w)]
    return list(dict.fromkeys(phrases + keep))


def highlight(c: Column | str, terms: list[str]) -> Column:
    """Marks each term in escaped text; terms of 2 to 30 characters match across white space."""
    text = col(c)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    loose = [r"\s*".join("\\Q" + x + "\\E" for x in t) if 2 <= len(t) <= 30 else "\\Q" + t + "\\E" for t in terms]
    return F.regexp_replace(text, "(?i)(?:" + "|".join(loose) + ")", "<mark>$0</mark>")
