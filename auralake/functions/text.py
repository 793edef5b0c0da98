"""Text normalisation and composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end (trim() knows blanks only)."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def sanitize(text: Column) -> Column:
    """Lower case; line ends and runs of blanks as one blank; of a run of , . ? its last mark; stripped."""
    text = F.regexp_replace(F.lower(text), r"\n+", " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"([,\.?])+", "$1"))


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ?, with their mark, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])"), strip), lambda s: s != "")


def sample_id(path: Column) -> Column:
    """The file's name without folder and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    """The file's suffix in lower case, with its dot; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_name(model: Column, ending: str = ".csv") -> Column:
    """A model's name as a file name."""
    return F.concat(F.replace(model, F.lit("/"), F.lit("__")), F.lit(ending))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def marks_to_words(text: Column) -> Column:
    """Commas and full stops as the tokens <comma> and <period> of transcripts."""
    return F.replace(F.replace(text, F.lit(","), F.lit(" <comma>")), F.lit("."), F.lit(" <period>"))


def words_to_marks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s*<comma>", ","), r"\s*<period>", ".")


def http_error(status: Column) -> Column:
    return F.format_string("HTTP %d", status)
