"""Text functions over columns: names, redaction, clipping and log slicing. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "<redacted>"
#: Names whose values are secret, and the prefixes of raw keys.
SECRET_NAMES = "api_key|base_url|anthropic_api_key|anthropic_auth_token|ark_api_key"
KEY_PREFIXES = "ark|sk-ant|sk"
#: The notice behind a clipped observation.
CLIP_NOTICE = (
    "\n<response clipped>\n<NOTE>The observation exceeded {limit} characters, so ", " were elided. "
    "Retry with something that yields less output (e.g. head/tail/grep, or redirect to a file); do not use interactive pagers.</NOTE>",
)


def image_name(instance_id: Column, registry: str = "swebench/") -> Column:
    """Container image of a task instance (F1)."""
    return F.concat(F.lit(registry + "sweb.eval.x86_64."), F.replace(F.lower(instance_id), F.lit("__"), F.lit("_1776_")))


def local_image(image: Column) -> Column:
    """Image name on a host without registry (F3): no registry host, ``__`` back, tag ``latest``."""
    own = F.when(F.substring_index(image, "/", 1).contains("."), F.substring_index(image, "/", -1)).otherwise(image)
    return F.concat(F.regexp_replace(F.replace(own, F.lit("_1776_"), F.lit("__")), ":[^:]*$", ""), F.lit(":latest"))


def redact(text: Column) -> Column:
    """Five passes over named values (quoted, bare), endpoints, bearer tokens and raw keys."""
    for pattern, put in (
        (rf"""(?i)(["']?(?:{SECRET_NAMES})["']?\s*[:=]\s*)(["'])(?:.*?)\2""", f"$1$2{REDACTED}$2"),
        (rf"""(?i)(\b(?:{SECRET_NAMES})\b\s*[:=]\s*)(?!["'])[^,\s}}\])]+""", f"$1{REDACTED}"),
        (r"""(?i)(\bendpoint\s*[:=]\s*)(["']?)https?://[^\s,"')]+\2""", f"$1$2{REDACTED}$2"),
        (r"(?i)(\bAuthorization\s*:\s*Bearer\s+)[^\s,]+", f"$1{REDACTED}"),
        (rf"(?i)\b(?:{KEY_PREFIXES})-[A-Za-z0-9_-]{{24,}}\b", REDACTED),
    ):
        text = F.regexp_replace(text, pattern, put)
    return text


def short_name(name: Column, prefix: str, width: int = 22) -> Column:
    """Logger name without ``prefix``, its tail behind an ellipsis if longer than ``width``."""
    own = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)
    return F.when(F.length(own) > width, F.concat(F.lit("…"), F.right(own, F.lit(width - 1)))).otherwise(own)


def strip_ansi(text: Column, colours_only: bool = False) -> Column:
    """Without terminal control sequences and carriage returns."""
    return F.regexp_replace(text, r"\x1b\[[0-9;]*m|\r" if colours_only else r"\x1b\[[0-?]*[ -/]*[@-~]|\r", "")


def clip_observation(text: Column, limit: int = 100_000) -> Column:
    """An observation of at most ``limit`` characters and a notice of what was left out."""
    text = F.coalesce(text, F.lit(""))
    head, tail = CLIP_NOTICE
    clipped = F.concat(F.left(text, F.lit(limit)), F.lit(head.format(limit=limit)), (F.length(text) - limit).cast("string"), F.lit(tail))
    return F.concat(F.lit("Observation:\n"), F.when(F.length(text) > limit, clipped).otherwise(text))


#: Characters that count as white space at the ends of a text, and texts that count as numbers.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[+-]?(?:(?i:inf|infinity|nan)|(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)\z"

#: What a command's text says around its output.
EXIT_HEAD, STDOUT_HEAD, STDERR_HEAD, NO_OUTPUT = "[exit code: ", "[stdout]\n", "[stderr]\n", "(empty)"
PARTIAL_HEADS = ("[partial stdout]\n", "[partial stderr]\n")
TIMEOUT_TEXT = (
    "The command was cancelled because it took more than ", " seconds. Please try a different command that completes more quickly. A common cause "
    "is a command that is interactive or waits for input -- this environment cannot provide input, so such a command never completes.",
)


def _clean_end(text: Column) -> Column:
    """Output without control sequences and white space at its end; null where nothing is left."""
    return F.nullif(rstrip(strip_ansi(text)), F.lit(""))


def exit_block(code: Column, stdout: Column, stderr: Column) -> Column:
    """Text of a finished command."""
    head = F.concat(F.lit(EXIT_HEAD), F.coalesce(code.cast("string"), F.lit("unknown")), F.lit("]"))
    return F.concat_ws("\n", head, F.concat(F.lit(STDOUT_HEAD), F.coalesce(_clean_end(stdout), F.lit(NO_OUTPUT))), F.concat(F.lit(STDERR_HEAD), _clean_end(stderr)))


def timeout_block(seconds: Column, stdout: Column, stderr: Column) -> Column:
    """Text of a command that took too long, with what it had put out by then."""
    number = F.regexp_replace(seconds.cast("string"), r"\.0+$", "")
    outs = [F.concat(F.lit(head), _clean_end(c)) for head, c in zip(PARTIAL_HEADS, (stdout, stderr), strict=True)]
    return F.concat_ws("\n", F.concat(F.lit(TIMEOUT_TEXT[0]), number, F.lit(TIMEOUT_TEXT[1])), *outs)


def failure_reason(error_class: Column, message: Column) -> Column:
    """``Class:message`` of at most 512 characters; the class stands in for no message."""
    return F.left(F.concat(error_class, F.lit(":"), F.coalesce(F.nullif(message, F.lit("")), error_class)), F.lit(512))


def strip(text: Column) -> Column:
    """Text without white space at its ends: of any kind, not only spaces."""
    return F.btrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    """Text without white space at its end."""
    return F.rtrim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    """Whether a text is null, empty or white space."""
    return F.coalesce(strip(text), F.lit("")) == ""


def number(text: Column) -> Column:
    """Text that is a decimal number, with an exponent or not, as a double; null for anything else, as ``1.5d``."""
    own = strip(text)
    return F.when(own.rlike(NUMBER), F.replace(own, F.lit("_"), F.lit("")).try_cast("double"))


def safe_filename(name: Column) -> Column:
    """Letters, digits, ``_`` and ``-``; ``default`` for nothing."""
    own = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(own, F.lit("")), F.lit("default"))


def strip_version(url: Column) -> Column:
    """A base URL without trailing slashes and one ``/v1``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/v1$", ""), "/+$", "")


def between_markers(text: Column, start: str, end: str) -> Column:
    """Text behind the first start marker up to the next end marker; null without both."""
    rest = F.substr(text, F.locate(start, text) + len(start))
    return F.when(text.contains(start) & rest.contains(end), F.substring_index(rest, end, 1))


def between_split(text: Column, start: str, end: str) -> Column:
    """Like ``between_markers``, but a second start marker ends the text too (F29), and the order of the markers is free."""
    found = text.contains(start) & text.contains(end)
    return F.when(found, F.substring_index(F.split_part(text, F.lit(start), F.lit(2)), end, 1))


def strict_list(value: Column) -> Column:
    """A list given as JSON text, else null."""
    return F.from_json(value, "array<string>")


def lenient_list(value: Column) -> Column:
    """A list given as JSON text; text that is none is a list of itself, blank text and null are empty."""
    parsed = F.try_parse_json(value)
    listed = F.try_variant_get(parsed, "$", "array<string>")
    return F.when(is_blank(value), F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(value)))


def decode_list(value: Column) -> Column:
    """A list given as JSON text; null and blank text are the empty list."""
    return F.when(is_blank(value), F.array().cast("array<string>")).otherwise(F.from_json(value, "array<string>"))


def issue_text(text: Column, open_tag: str, close_tag: str, marker: str) -> Column:
    """Text between tags, else before a marker, else all of it; trimmed."""
    start, end = F.locate(open_tag, text), F.locate(close_tag, text)
    tagged = F.when((start > 0) & (end > start), F.substr(text, start + len(open_tag), end - start - len(open_tag)))
    return strip(F.coalesce(tagged, F.when(text.contains(marker), F.substring_index(text, marker, 1)), text))


def tail(text: Column, n: int) -> Column:
    """The last ``n`` characters of trimmed text (SL4)."""
    return F.right(strip(text), F.lit(n))


def env_flag(value: Column) -> Column:
    """Whether a setting is switched on."""
    return F.coalesce(F.lower(strip(value)).isin("1", "true", "yes", "on"), F.lit(False))


def env_number(value: Column, default: float) -> Column:
    """A setting as a number; blank, missing and unreadable ones are the default."""
    return F.coalesce(number(value), F.lit(float(default)))
