"""Text functions as Columns: cleaning, normalising, escaping, and their driver-side twins."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values ---------------------------------------------------------------------------------
TERM_SEPARATORS = r"[\s,，、;；+|/]+"
MISSING = ("", "-", "--", "—", "–", "/", "\\", "无", "暂无", "空", "n/a", "na", "nan", "none", "null")
FULLWIDTH_PUNCTUATION = ("，。、；：？！（）【】《》“”‘’·～—", ",.,;:?!()[]<>\"\"''.~-")
INVISIBLE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b-\u200f\u2028\u2029\ufeff]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TYPOS = (
    ("选调牛", "选调生"), ("选调华", "选调生"), ("中央民旋大学", "中央民族大学"), ("民旋大学", "民族大学"), ("民旌大学", "民族大学"),
    ("经验分享佘", "经验分享会"), ("分享佘", "分享会"), ("交流佘", "交流会"), ("座谈佘", "座谈会"), ("共美沙尤", "共美沙龙"),
    ("共美沙笼", "共美沙龙"), ("时问", "时间"), ("地占", "地点"), ("主讲八", "主讲人"), ("联系电活", "联系电话"),
)
NOISE_LINES = (
    r"^\s*$", r"^[\W_]+$", r"^[-=_·．\.•—]{2,}$", r"spacer\.gif", r"^(微信号|公众号|微信公众号)\s*[:：]?", r"^长按.{0,6}(识别|关注)",
    r"^扫(一)?扫.{0,6}(二维码|关注)", r"^\s*\d{1,3}\s*/\s*\d{1,3}\s*$", r"^扫(一)?扫(关注|参加|报名)?我们?$", r"^扫码(关注|参加|报名|入群)?",
    r"^(腾讯会议|会议号|会议ID)", r"^关注我们", r"^招生就业工作处$", r"^(学生)?就业(指导)?(工作)?(处|中心)$", r"工作室$", r"^等最好的你",
    r"^[\"“”'‘’]?职[\"“”'‘’]?$", r"^(主办|承办|协办|指导)(单位|部门)?\s*[:：]?$",
)
FOOTER_LINES = (r"^扫\s*码", r"^扫一扫", r"^腾讯会议", r"^关注我们", r"^招生就业工作处", r"^学生就业指导中心", r"工作室\s*$", r"^等最好的你")
REGION_SUFFIXES = ("特别行政区", "自治区", "省", "市")
# ----------------------------------------------------------------------------------------------


def ascii_lower(x: Column | str) -> Column:
    """Lower case of A-Z only, as a LIKE without Unicode folding compares."""
    return F.translate(x, _UPPER, _LOWER)


def ascii_lower_text(x: str) -> str:
    return x.translate(str.maketrans(_UPPER, _LOWER))


def unique_in_order(values: Iterable) -> list[str]:
    """Stripped, without blanks and repeats, first occurrences first."""
    return list(dict.fromkeys(s for v in values if v is not None and (s := str(v).strip())))


def unique_in_order_col(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def parse_query(text: str | None) -> list[str]:
    return unique_in_order(re.split(TERM_SEPARATORS, text or ""))


def parse_query_col(text: Column) -> Column:
    return unique_in_order_col(F.split(F.coalesce(text, F.lit("")), "(?U)" + TERM_SEPARATORS))


def normalize_latin(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def is_latin(x: Column) -> Column:
    """Only Latin letters, digits, white space and - . ' ’, with a letter among them."""
    return F.coalesce(x.rlike(r"^[A-Za-z0-9\s\-.'’]+$") & x.rlike("[A-Za-z]"), F.lit(False))


def is_latin_text(x: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9\s\-.'’]+", x) and re.search("[A-Za-z]", x))


def escape_html(x: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(x, F.lit("")))


def first_nonblank(*columns: Column) -> Column:
    """The first value that isn't blank, as it is."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def digit_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"([0-9]+)"), 1)


def shorten_region(x: Column) -> Column:
    """Without the suffix of a region, unless nothing else is left."""
    return F.regexp_replace(x, f"(?<=.)({'|'.join(REGION_SUFFIXES)})$", "")


def display_value(dimension: str, x: Column) -> Column:
    if dimension == "cohort_year":
        return F.concat(x.cast("string"), F.lit("届"))
    return shorten_region(x) if dimension == "province" else x.cast("string")


def strip_invisible(x: Column) -> Column:
    return F.regexp_replace(x, INVISIBLE, "")


_WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + FULLWIDTH_PUNCTUATION[0]
_NARROW = " " + "".join(chr(c) for c in range(0x21, 0x7F)) + FULLWIDTH_PUNCTUATION[1]
#: The first translation of a character counts, as in ``translate`` of Spark.
_WIDTHS = {ord(w): n for w, n in reversed(list(zip(_WIDE, _NARROW)))}


def normalize_width(x: Column) -> Column:
    """Full-width ASCII and space to half width, then CJK punctuation to ASCII: one translation."""
    return F.translate(x, _WIDE, _NARROW)


def fold_digits(x: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(x, "０１２３４５６７８９", "0123456789")


def now_text() -> Column:
    """The current time as ISO text with whole seconds; one value for all rows of a query."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def fix_typos(x: Column, typos: Sequence[tuple[str, str]] = TYPOS) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), typos, x)


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Spark has no NFKC; whole Arrow batches go through the standard library's."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_text(x: Column, fullwidth: bool = True, typos: bool = True) -> Column:
    x = strip_invisible(x)
    if fullwidth:
        # ASCII is its own normal form: such texts don't go to Python.
        wide = nfkc(F.when(x.rlike("[^\\x00-\\x7f]"), x))
        x = F.when(wide.isNull(), x).otherwise(normalize_width(wide))
    return fix_typos(x) if typos else x


def normalize_plain(x: str) -> str:
    """``normalize_text`` of a string."""
    if x.isascii():
        return x if x.isprintable() else re.sub(INVISIBLE, "", x)
    x = unicodedata.normalize("NFKC", re.sub(INVISIBLE, "", x)).translate(_WIDTHS)
    return reduce(lambda t, p: t.replace(*p), TYPOS, x)


def collapse_repeats(x: Column, most: int = 3) -> Column:
    """A unit of one or two characters that repeats more often than ``most`` is kept twice."""
    return F.regexp_replace(x, rf"(.{{1,2}})\1{{{most},}}", "$1$1")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_noise(line: Column) -> Column:
    return line.rlike("(?iu)(?U)(?:" + "|".join(NOISE_LINES) + ")")


def is_footer(line: Column) -> Column:
    return let(F.trim(F.coalesce(line, F.lit(""))), lambda x: (x != "") & x.rlike("(?U)(?:" + "|".join(FOOTER_LINES) + ")"))


def split_lines(x: Column) -> Column:
    """Lines at every line boundary of Unicode, without the empty one after a last line end."""
    return let(F.split(x, LINE_END), lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))


def before_footer(lines: Column) -> Column:
    """Lines up to the first footer line; all without one."""
    cut = F.array_position(F.transform(lines, is_footer), F.lit(True))
    return let(F.nullif(cut, F.lit(0)), lambda at: F.slice(lines, 1, F.coalesce(at - 1, F.size(lines).cast("long")).cast("int")))


def unique_lines(lines: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(lines)


_LINE_END, _INVISIBLE, _BLANK = re.compile(LINE_END), re.compile(INVISIBLE), re.compile(r"[　\s]+")
_REPEAT = {most: re.compile(rf"(.{{1,2}})\1{{{most},}}") for most in (3,)}
#: Patterns from a line's beginning are tried there alone; few others look into it.
_NOISE_HEAD = re.compile("|".join(p for p in NOISE_LINES if p.startswith("^")), re.I)
_NOISE_INSIDE = [re.compile(p, re.I) for p in NOISE_LINES if not p.startswith("^")]
_FOOTER_HEAD = re.compile("|".join(p for p in FOOTER_LINES if p.startswith("^")))
_FOOTER_INSIDE = [re.compile(p) for p in FOOTER_LINES if not p.startswith("^")]


def noise_line(line: str) -> bool:
    """``is_noise`` of a string."""
    return bool(_NOISE_HEAD.match(line)) or any(p.search(line) for p in _NOISE_INSIDE)


def footer_line(line: str) -> bool:
    """``is_footer`` of a string."""
    line = line.strip()
    return bool(line) and (bool(_FOOTER_HEAD.match(line)) or any(p.search(line) for p in _FOOTER_INSIDE))


def cleaned_lines(text: str, least: int = 2, spaces: str = "", normalize: bool = True, dedupe: bool = True) -> list[str]:
    """Lines of a text: normalised, up to the first footer line, without noise, short and repeated lines."""
    # Line ends first: some of them count as invisible characters in a line.
    text = _LINE_END.sub("\n", text)
    text = _REPEAT[3].sub(r"\1\1", normalize_plain(text) if normalize else text)
    out = []
    for line in text.split("\n"):
        line = _BLANK.sub(spaces, line).strip()
        if line and footer_line(line):
            break
        if len(line) >= max(least, 1) and not noise_line(line):
            out.append(line)
    return list(dict.fromkeys(out)) if dedupe else out


def clean_lines(text: Column, least: int = 2, spaces: str = "", normalize: bool = True, dedupe: bool = True) -> Column:
    """``cleaned_lines`` of a column: a text passes through Python once, in Arrow batches, as it has to for NFKC."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cleaned_lines(t, least, spaces, normalize, dedupe) for t in texts], dtype=object)

    return cleaned(text)


def clean_value(x: Column) -> Column:
    """Trimmed and squeezed; markers of missing values become null; whole floats lose their fraction."""
    value = F.trim(F.regexp_replace(F.replace(x.cast("string"), F.lit("　"), F.lit(" ")), r"(?U)\s+", " "))
    value = F.regexp_replace(value, r"^(-?[0-9]+)\.0$", "$1")
    return F.when(~F.lower(value).isin(*MISSING), value)


def normalize_name(x: Column) -> Column:
    return F.regexp_replace(clean_value(x), r"(?U)\s+", "")


def bare_text(x: Column) -> Column:
    """Without punctuation and spaces, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[\s\p{Punct}·—－（），。、；：“”‘’]+", "")


def image_stem(x: Column) -> Column:
    """Base name of a path of either style, without an image extension."""
    base = F.element_at(F.split(F.coalesce(x, F.lit("")), r"[/\\]"), -1)
    return F.regexp_replace(base, r"(?i)\.(jpg|jpeg|png|gif|bmp|webp)$", "")


def image_stem_plain(x: str) -> str:
    return re.sub(r"\.(jpg|jpeg|png|gif|bmp|webp)$", "", re.split(r"[/\\]", x)[-1], flags=re.I)


def short_hash(x: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of SHA-1, which tell files of one name apart."""
    return F.substring(F.sha1(x), 1, digits)


def normalize_url(x: Column) -> Column:
    """Without the default port of its scheme."""
    return F.regexp_replace(F.regexp_replace(x, r"^(http://[^/:]*):80(?=/|$)", "$1"), r"^(https://[^/:]*):443(?=/|$)", "$1")


def safe_filename(x: Column, longest: int = 60, default: str = "untitled") -> Column:
    name = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r'[\\/:*?"<>|\r\n\t]+', "_"), r"(?U)\s+", " "))
    name = F.substring(name, 1, longest)
    return F.when(name == "", F.lit(default)).otherwise(name)


def url_extension(x: Column, default: str = ".jpg") -> Column:
    found = F.lower(F.regexp_extract(F.regexp_replace(x, r"[?#].*$", ""), r"(?i)(\.(?:jpg|jpeg|png|gif|bmp|webp))$", 1))
    return F.when(found == "", F.lit(default)).otherwise(found)


def encode_path(x: Column) -> Column:
    """Percent-encoded with slashes kept and spaces as %20."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, plain in (("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def labelled(pairs: Sequence[tuple[str, Column]], between: str = "；") -> Column:
    """``label：value`` of the values that aren't blank."""
    return F.concat_ws(between, *[F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{label}："), c.cast("string"))) for label, c in pairs])


def compact_date(x: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; anything else is null."""
    return F.when(x.rlike(r"^[0-9]{8}$"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)))


def alias_key(text: str | None) -> str:
    """NFKC, without white space, in lower case: how alias terms compare."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text or "")).lower()


def windows(text: str, size: int) -> Iterator[str]:
    for i in range(len(text) - size + 1):
        yield text[i : i + size]
