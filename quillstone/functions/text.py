"""Column expressions for captions, prompts, names and paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def mapped(code: Column, words: Mapping[str, str], default: str | None = None) -> Column:
    """The wording of a code; ``default`` (or null) for any other, null included."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.element_at(table, code), F.lit(default)) if default is not None else F.element_at(table, code)


def band(volume: Column, names: Sequence[str]) -> Column:
    """The name of the left-closed band that a volume is in."""
    out = F.when(volume < fixed.BANDS[0], names[0])
    for bound, name in zip(fixed.BANDS[1:], names[1:], strict=False):
        out = out.when(volume < bound, name)
    return out.when(volume.isNotNull(), names[-1])


def size_phrase(volume: Column) -> Column:
    return band(volume, fixed.BAND_PHRASES)


def size_label(volume: Column) -> Column:
    return band(volume, fixed.BAND_LABELS)


def _edit_clause(volume: Column, shape: Column, profile: Column, brand: Column) -> Column:
    style = F.coalesce(F.concat(F.lit(", in the style of "), mapped(brand, fixed.BRAND_WORDS)), F.lit(""))
    return F.concat(F.lit(fixed.EDIT_SENTENCE), volume.cast("string"), F.lit(" cc "), mapped(shape, fixed.SHAPE_WORDS, fixed.DEFAULT_SHAPE_WORDS), F.lit(", using "), mapped(profile, fixed.PROFILE_WORDS, fixed.DEFAULT_PROFILE_WORDS), style, F.lit("."))


def caption(volume: Column, shape: Column, profile: Column, brand: Column) -> Column:
    """The training caption of a pair; the volume stays as it is."""
    return F.concat(_edit_clause(volume, shape, profile, brand), F.lit(" The change should read as "), size_phrase(volume), F.lit(". "), F.lit(fixed.KEEP_SENTENCE))


def clamp(volume: Column, low: int = fixed.PREVIEW_VOLUME[0], high: int = fixed.PREVIEW_VOLUME[1]) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), volume))


def edit_prompt(volume: Column, shape: Column, profile: Column, brand: Column) -> Column:
    """The preview prompt, line by line; the volume is clamped to what previews offer."""
    cc = clamp(volume)
    reads = F.concat(F.lit("The change should read as "), size_phrase(cc), F.lit(fixed.PROMPT_BAND_TAIL))
    return F.concat_ws("\n", F.lit(fixed.PROMPT_HEAD), _edit_clause(cc, shape, profile, brand), reads, *map(F.lit, fixed.PROMPT_RULES))


#: What a browser's and server's trim takes for white space.
TRIMMED = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"^{TRIMMED}+|{TRIMMED}+$", "")


def client_key(forwarded_for: Column) -> Column:
    """The first address of a forwarded-for header, trimmed; ``unknown`` without one."""
    first = trimmed(F.get(F.split(forwarded_for, ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("unknown"))


def label(*parts: Column) -> Column:
    """clinic/pair, or clinic/pair/stem."""
    return F.concat_ws("/", *parts)


def dataset_path(split: Column, side: str, pair_id: Column, extension: str = "jpg") -> Column:
    return F.concat(split, F.lit(f"/{side}/"), pair_id, F.lit(f".{extension}"))


def extension_of(mime: Column) -> Column:
    return mapped(mime, fixed.EXTENSION_BY_MIME, "png")


def download_name(brand: Column, shape: Column, volume: Column, mime: Column) -> Column:
    """The file name of a result, from the configuration that made it."""
    return F.concat(F.lit("preview-"), brand, F.lit("-"), shape, F.lit("-"), volume.cast("string"), F.lit("cc."), extension_of(mime))


def data_url(mime: Column, base64: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64)


def data_url_payload(url: Column) -> Column:
    """What follows the first comma of a data URL."""
    return F.get(F.split(url, ","), F.lit(1))


def error_detail(body: Column) -> Column:
    """A provider's error text, as much of it as is logged."""
    return F.substring(body, 1, 500)
