"""Text scalars: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chapter heading with a number (fixed value).
TITLE_NUMBER = r"第\s*([0-9一二三四五六七八九十百千万零〇两]+)\s*[章节回卷集]"
#: Values of numerals (fixed values).
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100, "千": 1000, "万": 10000, "两": 2}


def strip(text: Column) -> Column:
    """Removes white space of any script at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalize_blank_lines(text: Column) -> Column:
    """Stripped lines, one empty line at most between others."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return strip(F.regexp_replace(F.array_join(F.transform(lines, strip), "\n"), "\n{3,}", "\n\n"))


def normalize_markup(text: Column) -> Column:
    """Text without scripts, styles, tags and control characters; non-empty
    lines with single blanks."""
    out = F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style>", "")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]+>", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    lines = F.transform(F.split(out, "\r\n|[\n\r\u0085  ]"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def chapter_title(raw: Column) -> Column:
    """What stands before the first empty line, or the whole text."""
    at = F.instr(raw, "\n\n")
    return strip(F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(raw))


def chapter_body(raw: Column) -> Column:
    """What stands after the first empty line; empty without one."""
    at = F.instr(raw, "\n\n")
    return F.when(at > 0, strip(F.substring(raw, at + 2, F.length(raw)))).otherwise(F.lit(""))


def format_chapter(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), body)


def safe_filename(name: Column, length: int = 120) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, r"[\\/:*?\"<>|\r\n\t]+", "_"), r"^[ ._]+|[ ._]+$", "")
    return F.coalesce(F.nullif(F.substring(out, 1, length), F.lit("")), F.lit("untitled"))


def safe_name(name: Column, fallback: str = "untitled", length: int = 80) -> Column:
    out = F.regexp_replace(F.regexp_replace(strip(name), r"(?U)[/\\?%*:|\"<>\r\n\s#]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.substring(F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback)), 1, length)


def numeral(text: Column) -> Column:
    """Digits, or numerals summed by place; -1 at an unknown character."""
    values = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"), F.lit(True).alias("ok"))

    def step(s, ch):
        v = F.coalesce(values[ch].cast("long"), F.lit(-1).cast("long"))
        unit = v >= 10
        return F.struct(
            F.when(unit, s["total"] + F.greatest(s["now"], F.lit(1).cast("long")) * v).otherwise(s["total"]).alias("total"),
            F.when(unit, F.lit(0).cast("long")).otherwise(v).alias("now"),
            (s["ok"] & (v >= 0)).alias("ok"),
        )

    folded = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda s: F.when(s["ok"], s["total"] + s["now"]).otherwise(F.lit(-1).cast("long")))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).otherwise(folded)


def fix_title(index: Column, title: Column) -> Column:
    """The title with its number set to the chapter's index; a default title
    where there is none."""
    found = F.regexp_extract(title, "(?U)" + TITLE_NUMBER, 1)
    fixed = F.concat(F.lit("第"), index.cast("string"), F.lit("章"))
    before = F.regexp_extract(title, "(?Us)^(.*?)" + TITLE_NUMBER, 1)
    after = F.regexp_extract(title, "(?Us)^.*?" + TITLE_NUMBER + "(.*)$", 2)
    return F.when(F.coalesce(title, F.lit("")) == "", fixed).when(found == "", title).when(numeral(found) == index, title).otherwise(F.concat(before, fixed, after))


def preview(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("\n\n..."))).otherwise(text)


def length_bucket(n: Column) -> Column:
    return F.when(n <= 16, "1-16").when(n <= 64, "17-64").otherwise("65+")


def progress_bar(current: Column, total: Column, width: int = 30) -> Column:
    share = F.least(current / total, F.lit(1.0))
    filled = F.floor(share * width).cast("int")
    bar = F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled), F.lit("] "))
    done = F.concat(bar, F.floor(share * 100).cast("string"), F.lit("% ("), current.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))
    return F.when(total <= 0, F.lit(f"[{'?' * width}] 0%")).otherwise(done)


def has_hangul(text: Column) -> Column:
    return text.rlike("[\\x{AC00}-\\x{D7A3}]")


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def srt_seconds(stamp: Column) -> Column:
    part = lambda k: F.regexp_extract(stamp, r"^(\d+):(\d+):(\d+),(\d+)$", k).cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000.0


def srt_timestamp(seconds: Column) -> Column:
    ms = F.greatest(F.round(seconds * 1000).cast("long"), F.lit(0).cast("long"))
    whole = lambda by: F.floor(ms / by).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms % 1000)


def decode_map(text: Column, pairs: dict[str, str]) -> Column:
    """Replaces characters by a map."""
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a shorter text is its own."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(n < 2, F.array(text)).otherwise(F.array_distinct(pairs))


#: Promotional phrases, cut out of lines that keep their story (fixed values).
PROMOTIONS = (
    r"请收藏本站[，,。；;、\s]*",
    r"最新网址(?:[：:]\s*(?:https?://)?(?:www\.)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::\d{1,5})?(?:[/?#][A-Za-z0-9._~:/?#@!$&'()*+=%-]*[A-Za-z0-9_~/#@&+=%-])?)?[，,。；;、\s]*",
    r"手机阅读(?:更方便)?[，,。；;、\s]*",
    r"加入书签[，,。；;、！!\s]*",
)
#: Unnumbered parts of a book (fixed values).
SPECIAL_PART = r"(?i)^(?:prologue|epilogue|foreword|afterword|interlude|序章|楔子|番外(?:\s*\d+)?)$"
#: Labels before an author's name (fixed values).
AUTHOR_LABEL = r"(?is)^(?:作者\s*[：:]?|by\s+|written\s+by\s+|author\s*[：:]\s*)(.+)$"
#: Error codes that may be stored (fixed values).
ERROR_CODES = """chapter_download_failed chapter_content_duplicate chapter_content_empty chapter_redirect_mismatch chapter_title_mismatch
chapter_processor_failed connection_timeout duplicate_content empty_content parse_failed source_fetch_failed""".split()
#: What makes a text unsafe to show (fixed values).
UNSAFE_TEXT = (
    r"(?i)https?://|(?<![A-Za-z0-9_])[A-Za-z]:[\\/][^\s]+|(?<![A-Za-z0-9_])\\\\[^\\\s]+\\[^\s]+|(?<![A-Za-z0-9_])/(?:[^/\s]+/)*[^/\s]+"
    r"|(?:password|passwd|token|secret|cookie|authorization|profile[_ -]?path)\s*[:=]"
)
#: Names of credentials (fixed values).
CREDENTIAL = (
    r"(?:browser[ _-]*token|access[ _-]*token|api[ _-]*(?:token|key)|refresh[ _-]*token|session[ _-]*(?:token|id)|auth[ _-]*token"
    r"|private[ _-]*key|secret[ _-]*key|password|passwd|cookie|token|secret)"
)
#: Rules that find sensitive text, by name (fixed values).
SENSITIVE = {
    "authorization_header": r"(?im)^\s*authorization\s*:\s*(?:bearer\s+)?\S+",
    "credential_equals": rf"(?i)(?<![a-z0-9]){CREDENTIAL}\s*=\s*\S+",
    "credential_json": rf"""(?i)["']{CREDENTIAL}["']\s*:\s*["'][^"']+["']""",
    "cookie_header": r"(?im)^\s*cookie\s*:\s*[^\s=;]+=[^\s;]+",
    "html": r"(?i)<\s*(?:html|body)(?:\s|>)",
    "profile_path": r"(?i)profile(?:_|\s+)path\s*[:=]\s*\S+",
}
#: Parts of metadata keys that mark them sensitive (fixed values).
SENSITIVE_KEYS = """api_key authorization browser_token content cookie credential html page_body password passwd private_key
profile_path resume_status session_id secret token""".split()


def drop_promotions(text: Column) -> Column:
    """Text without promotional phrases; what stands around them stays."""
    for pattern in PROMOTIONS:
        text = F.regexp_replace(text, pattern, "")
    return text


def drop_lines(body: Column, holding: tuple[str, ...] = (), equal: tuple[str, ...] = ()) -> Column:
    """Body without lines that hold one of `holding` or are one of `equal`."""

    def stays(line):
        gone = F.lit(False)
        for phrase in holding:
            gone = gone | line.contains(phrase)
        return ~(gone | strip(line).isin(*equal)) if equal else ~gone

    return F.array_join(F.filter(F.split(body, "\n"), stays), "\n")


def link_number(label: Column, href: Column) -> Column:
    """Chapter number of a link: from its label, else the first digits of its
    href; null for special parts and labels that count books or volumes."""
    said = F.regexp_extract(label, r"(?i)(?:chapter\s+|第\s*)(\d+)(?![\d.])", 1).try_cast("long")
    inside = F.regexp_extract(href, r"(\d+)", 1).try_cast("long")
    return F.when(strip(label).rlike(SPECIAL_PART), F.lit(None).cast("long")).when(said.isNotNull(), said).when(label.rlike(r"(?i)\b(?:book|volume)\s+\d+"), F.lit(None)).otherwise(inside)


def author_of(label: Column) -> Column:
    """The name after an author label; null without one."""
    return F.nullif(strip(F.regexp_extract(label, AUTHOR_LABEL, 1)), F.lit(""))


def srt_blocks(srt: Column) -> Column:
    """Blocks of a subtitle file: array of (index, start, end, text). Blocks
    that are malformed go."""
    shape = r"(?s)^\s*(\d+)\s*\n(\d+:\d+:\d+,\d+)\s*-->\s*(\d+:\d+:\d+,\d+)[^\n]*\n?(.*)$"
    part = lambda b, k: F.regexp_extract(b, shape, k)
    blocks = F.filter(F.split(F.regexp_replace(srt, "\r\n?", "\n"), r"\n\s*\n"), lambda b: b.rlike(shape))
    return F.transform(blocks, lambda b: F.struct(part(b, 1).try_cast("int").alias("index"), srt_seconds(part(b, 2)).alias("start"), srt_seconds(part(b, 3)).alias("end"), strip(part(b, 4)).alias("text")))


def sensitive_hits(text: Column, display: bool = False) -> Column:
    """Names of the rules that find something sensitive; display text allows
    labels before plain words and bearer words."""
    bare = lambda v: F.regexp_replace(v, r"^[\"'()\[\]{}]+|[\"'()\[\]{}]+$", "")
    values = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![a-z0-9_]){CREDENTIAL}\s*:\s*=?\s*([^\s,;]+)"), 1)

    def shown(v):
        c = F.regexp_replace(bare(v), r"[.,;:]+$", "")
        word = c.rlike(r"^\p{L}+$") & (c == F.lower(c))
        return F.lower(c).rlike("^(?:sk-|pk-|ghp_)") | c.rlike(r"\d") | word | ((F.length(c) >= 16) & (c != F.initcap(c)))

    def key(v):
        c = bare(v)
        return (F.length(c) >= 6) & ((F.length(c) >= 16) | c.rlike(r"[\d._~+/=-]"))

    rules = [F.when(text.rlike(pattern), name) for name, pattern in SENSITIVE.items()]
    rules.append(F.when(F.exists(values, shown) if display else F.size(values) > 0, "credential_colon"))
    if not display:
        bearer = F.regexp_extract_all(text, F.lit(r"(?i)(?:^|\s)bearer\s+([a-z0-9._~+/=-]+)(?=$|[\s,;])"), 1)
        rules.append(F.when(F.exists(bearer, key), "bearer"))
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def sensitive_key(name: Column) -> Column:
    folded = F.regexp_replace(F.lower(name), r"[-\s]+", "_")
    return folded.rlike("|".join(SENSITIVE_KEYS))


def redact(text: Column, longest: int = 256) -> Column:
    """[redacted] for null, unsafe texts and control characters, else the first
    `longest` characters."""
    bad = text.isNull() | text.rlike(UNSAFE_TEXT) | text.rlike(r"[\x00-\x1f]")
    return F.when(bad, "[redacted]").otherwise(F.substring(text, 1, longest))


def safe_error_code(code: Column) -> Column:
    return F.when(code.isin(*ERROR_CODES), code).otherwise("chapter_download_failed")


def chapter_error(index: Column, stored: Column, title: Column, body: Column) -> Column:
    """Why a parsed chapter is refused, or null: an empty body, or a numbered
    title of another index where the stored title is blank or default."""
    raw = F.regexp_extract(strip(title), r"^第\s*([0-9零〇一二三四五六七八九十百千万两]+)\s*[章节回]", 1)
    default = strip(F.coalesce(stored, F.lit(""))).isin("") | (strip(stored) == F.concat(F.lit("第"), index.cast("string"), F.lit("章")))
    return F.when(F.coalesce(strip(body), F.lit("")) == "", "chapter_content_empty").when((raw != "") & default & (numeral(raw) != index), "chapter_title_mismatch")


def safe_count(n: Column) -> Column:
    return F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(2_147_483_647))


def safe_timestamp(stamp: Column) -> Column:
    """The text itself where it is an ISO time with a zone; else null."""
    zoned = stamp.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})$") & (F.length(stamp) <= 64)
    whole = F.regexp_replace(stamp, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})$", "$1:00$2")
    return F.when(zoned & F.try_to_timestamp(whole).isNotNull(), stamp)


def odd_bytes(body: Column) -> Column:
    """Whether UTF-8 bytes hold what another encoding would: NUL, a byte order
    mark, or a switch of mode."""
    value = body.cast("string")
    return value.contains("\0") | value.startswith("\ufeff") | value.contains("\x1b$") | value.contains("\x1b(J")
