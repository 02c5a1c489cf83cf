"""Scalar functions as Column expressions: text, numbers, times, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, punctuation that scores ignore, numeral characters, and three blocks of CJK characters.
WHITE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PUNCTUATION = r"[。，！？、；：\x{201C}\x{201D}\"'「」【】《》（）.,!?;:'\"()\[\]{}\x{2018}\x{2019}\x{3000}\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF1F}\x{FF1A}\x{FF1B}\x{2026}—～~-]"
NUMERALS = r"[0-9零一二两三四五六七八九十百千万亿]+"
CJK = r"[\x{4E00}-\x{9FFF}]"
CJK_BLOCKS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over hull; 0 for disjoint or empty intervals."""
    inter = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return F.coalesce(inter / F.nullif(F.greatest(a_end, b_end) - F.least(a_start, b_start), F.lit(0)), F.lit(0.0))


def js_round(x: Column) -> Column:
    """Half up, also for negative numbers: -2.5 gives -2."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def separation_progress(model: Column, shift: Column, ratio: Column, models: int, shifts: int) -> Column:
    """Percent done, 0 to 99."""
    done = (model * shifts + shift + ratio) / (models * shifts) * 100
    return clamp(F.floor(done), F.lit(0), F.lit(99)).cast("int")


def gigabytes(size: Column) -> Column:
    return F.when(size.isNull(), "N/A").otherwise(F.format_string("%.1f GB", (size / (1 << 30)).cast("double")))


def char_error_rate(ref: Column, hyp: Column, longest: bool = False) -> Column:
    """Edit distance over the reference's length, or over the longer of the two; 0 if both are empty."""
    size = F.greatest(F.length(ref), F.length(hyp)) if longest else F.length(ref)
    return F.levenshtein(ref, hyp) / F.greatest(size, F.lit(1))


def improvement(before: Column, after: Column) -> Column:
    """Relative gain in percent."""
    return (before - after) / F.greatest(before, F.lit(1e-4)) * 100


def normalize_for_score(text: Column) -> Column:
    """One spelling, no white space or punctuation, each run of numerals as ``#``."""
    one = F.regexp_replace(F.replace(text, F.lit("师父"), F.lit("师傅")), f"{WHITE}+", "")
    return F.regexp_replace(F.regexp_replace(one, PUNCTUATION, ""), NUMERALS, "#")


def sanitize(text: Column, fallback: str) -> Column:
    """A file name: other characters than word characters, CJK, dot and dash become ``_``; at most 120 characters."""
    name = F.regexp_replace(text, r"[^\w\x{4E00}-\x{9FFF}.-]", "_")
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(name, 1, 120), F.lit("")), F.lit(fallback))


def characters(text: Column) -> Column:
    """The characters of ``text``; none for an empty one."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def is_part_of(a: Column, b: Column) -> Column:
    """One is a proper part of the other; neither is empty."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.length(a) != F.length(b)) & (a.contains(b) | b.contains(a))


def similar_enough(a: Column, b: Column) -> Column:
    """The shorter text is empty, a part of the longer, or half of its characters occur there."""
    shorter, longer = (F.when(F.length(a) <= F.length(b), x).otherwise(y) for x, y in ((a, b), (b, a)))
    common = F.size(F.filter(characters(shorter), lambda c: longer.contains(c)))
    return (shorter == "") | longer.contains(shorter) | (2 * common >= F.length(shorter))


def shares_character(a: Column, b: Column) -> Column:
    return F.arrays_overlap(characters(a), characters(b))


def spans_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Both spans are there and overlap by more than a point."""
    return F.coalesce((a_low < b_high) & (b_low < a_high), F.lit(False))


def cjk_ratio(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(CJK)) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def is_cjk(text: Column) -> Column:
    """Whether ``text`` has CJK characters of any of the three blocks only, and at least one."""
    return F.coalesce(text.rlike(f"^{CJK_BLOCKS}+$"), F.lit(False))


def guarded_translation(src: Column, dst: Column, target: Column) -> Column:
    """The source where a translation is empty, or is to another language and still over three tenths CJK."""
    return F.when((target != "zh") & (cjk_ratio(dst) > 0.3), src).otherwise(F.coalesce(F.nullif(dst, F.lit("")), src))


def srt_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    whole = F.floor(ms)
    part = lambda unit: F.floor(whole / unit)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000), part(60_000) % 60, part(1000) % 60, whole % 1000)


def ordinal(number: Column, width: int = 4) -> Column:
    """``0007``; longer numbers as they are."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def short_duration(ms: Column) -> Column:
    """``—`` for null, else ``250ms``, ``12s`` or ``3m5s``."""
    seconds = F.floor(ms / 1000)
    long = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), (seconds % 60).cast("string"), F.lit("s"))
    return F.when(ms.isNull(), "—").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(long)


def ms_between(begin: Column, end: Column) -> Column:
    """Milliseconds between two ISO texts, 0 at least; null if either is."""
    at = lambda x: F.unix_millis(F.to_timestamp(x))
    return F.when(begin.isNotNull() & end.isNotNull(), F.greatest(at(end) - at(begin), F.lit(0)))


def now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def is_site(url: Column, domain: str) -> Column:
    """Whether a URL's host is ``domain`` or below it; other strings are not."""
    return F.coalesce((host(url) == domain) | host(url).endswith(f".{domain}"), F.lit(False))


def video_id(url: Column) -> Column:
    """The id that a video page's URL names: ``v=``, a short link's or embed's path, or a BV number; null for none."""
    first = lambda *found: F.coalesce(*[F.nullif(x, F.lit("")) for x in found])
    watch = F.regexp_extract(url, r"[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)", 1)
    path = F.regexp_extract(url, r"(?:youtu\.be|/embed|/shorts|/live)/([A-Za-z0-9_-]{11})(?:[/?&#]|$)", 1)
    bv = F.regexp_extract(url, r"/(BV[A-Za-z0-9]{10})(?:[/?&#]|$)", 1)
    return F.when(is_site(url, "youtube.com") | is_site(url, "youtu.be"), first(watch, path)).when(is_site(url, "bilibili.com"), first(bv))


def numbered_lines(answer: Column, expected: Column) -> Column:
    """The texts of lines like ``1: text``, ``2) text`` or ``3. text``; null unless there are as many as expected."""
    pattern = r"^\s*\d+\s*[):.]\s*(.+)"
    lines = F.transform(F.filter(F.split(answer, "\n"), lambda x: x.rlike(pattern)), lambda x: F.trim(F.regexp_extract(x, pattern, 1)))
    return F.when(F.size(lines) == expected, lines)


def lenient_json(text: Column) -> Column:
    """The text, or its first ``{…}`` span, whichever parses as JSON; null for neither."""
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    good = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(good(text), good(F.nullif(span, F.lit(""))))


def piece_text(raw: Column) -> Column:
    """Text of bytes; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def decode_piece(piece: Column) -> Column:
    """Text of a base64 token piece."""
    return piece_text(F.unbase64(piece))


def safe_size(x: Column, array: bool = False) -> Column:
    return F.coalesce(F.size(x) if array else F.length(x), F.lit(0))


def cut_or(text: Column, most: int, fallback: str) -> Column:
    """The first ``most`` characters of the trimmed text, or ``fallback`` for a null or blank one."""
    return F.coalesce(F.nullif(F.substring(F.trim(text), 1, most), F.lit("")), F.lit(fallback))


def pair_lines(pairs: Column, left: str = "src", right: str = "dst") -> Column:
    """An array of structs as lines ``left -> right``."""
    return F.array_join(F.transform(pairs, lambda x: F.concat_ws(" -> ", F.coalesce(x[left], F.lit("")), F.coalesce(x[right], F.lit("")))), "\n")


def device_name(name: Column) -> Column:
    """A device's name without the driver in brackets at its end."""
    return F.trim(F.regexp_replace(name, r"\s*\([A-Z]+ .*\)$", ""))


def run_label(path: Column) -> Column:
    """The last part of a path without its prefixes ``results-`` and ``ggml-``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), "^results-", ""), "^ggml-", "")


def parameter_label(prefix: str, values: dict[str, Column]) -> Column:
    """``prefix_a1_b2``: names and values in the order given."""
    return F.concat_ws("_", F.lit(prefix), *[F.concat(F.lit(k), v.cast("string")) for k, v in values.items()])


def time_id(ms: Column, size: int = 16) -> Column:
    """An id that sorts by time: milliseconds in base 36, and random characters up to ``size``."""
    stamp = F.lower(F.conv(ms.cast("string"), 10, 36))
    return F.concat(stamp, F.substring(F.lower(F.replace(F.uuid(), F.lit("-"), F.lit(""))), F.lit(1), F.lit(size) - F.length(stamp)))


def first_path(paths: Column, known: Column) -> Column:
    """The first of ``paths`` that is among ``known``; null for none."""
    return F.get(F.filter(paths, lambda x: F.array_contains(known, x)), F.lit(0))
