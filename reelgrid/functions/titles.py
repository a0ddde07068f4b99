"""The titles that a release may mean: an Arrow UDF, since each step looks at the list that the ones before made."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions.fields import GENRES, KINDS, LATIN, NATIVE, NO_TITLES, PEOPLE, REGIONS, brackets, label, numeric_title, title_words, variant_base, yearly_base
from reelgrid.functions.markers import kept_apart

ALIAS = re.compile(r"(?i)\b(?:aka|alias)\b")
YEAR = re.compile(r"^(?:19|20)\d{2}$")
TECHNICAL = re.compile(r"(?i)\b(?:\d{3,4}[pi]|4k|uhd|hdr10?|sdr|edr|web[- .]?dl|webrip|blu[- .]?ray|bdrip|hdtv|remux|[xh][ .]?26[45]|hevc|avc|avs|aac|dts|dolby\s*vision|flac|truehd|atmos|shout\s*factory|n/a|anonymous)\b")
NEW_SEASON = re.compile(r"^\d{1,2}\s*月\s*新番\s*[:：]\s*")
EDGES = " .。·:：,，;；/\\|—-*"
YEARS = re.compile(r"(?<![^\s.\[(])(?:19|20)\d{2}(?![^\s.\])])")
WRAPS, BLANKS, NO_WORD, NUMBERS = re.compile(r"[()\[\]{}（）「」『』]"), re.compile(r"\s+"), re.compile(r"[\W_]+"), re.compile(r"[\d\s/.,:-]+")
NAMED_KINDS = tuple(kind + colon for kind in KINDS for colon in ":：")
BREAKS = re.compile(r"\s+/\s+|[|｜]|—+|(?<=[^\d\s])/(?=[^\d\s])")
LABELS = frozenset(NO_TITLES) - {"genre"}
#: The parts of a title are looked at several times, one soon after another: the results for the last ones are kept.
lately = functools.lru_cache(maxsize=256)


@lately
def tidy(value: str) -> str:
    """A field's title, without brackets and what stands at its ends."""
    value = NEW_SEASON.sub("", value.strip(EDGES))
    if value.casefold().startswith(NAMED_KINDS):
        for kind in KINDS:
            if value.casefold().startswith((kind + ":", kind + "：")):
                value = value[len(kind) + 1 :]
    return BLANKS.sub(" ", WRAPS.sub(" ", title_words(value))).strip(EDGES)


@lately
def same(a: str) -> str:
    return NO_WORD.sub(" ", unicodedata.normalize("NFKC", a).casefold()).strip()


@lately
def is_field(value: str) -> bool:
    """Says something about a release: its kind, languages, people, sizes, numbers."""
    if numeric_title(value):
        return False
    return label(value) in LABELS or bool(NUMBERS.fullmatch(value)) or bool(TECHNICAL.search(value))


def is_title(value: str) -> bool:
    return bool(value) and any(c.isalnum() for c in value) and not is_field(value) and (len(value) > 1 or bool(NATIVE.search(value)))


def script_runs(value: str) -> list[str]:
    """Parts of one script each, if there are several."""
    runs: list[list] = []
    for word in value.split():
        native = bool(NATIVE.search(word))
        if runs and runs[-1][0] == native:
            runs[-1][1].append(word)
        else:
            runs.append([native, [word]])
    return [" ".join(ws) for _, ws in runs] if len(runs) > 1 else []


def pieces(value: str, years: frozenset = frozenset()) -> list[str]:
    """Alias parts, then parts between slashes, bars and long dashes, each after its runs of one script; a name that ends with one
    of these years also without it."""
    out = []
    for alias in ALIAS.split(value):
        if numeric_title(alias.strip(EDGES)):
            out.append(alias.strip(EDGES))
            continue
        if base := variant_base(alias):
            out.append(tidy(base))
        for part in BREAKS.split(alias):
            part = tidy(part)
            out += [*map(tidy, script_runs(part)), part]
            if part[-4:] in years and (base := yearly_base(part)):
                out.append(base)
    return out


def titles_of(head: str | None, raw: str | None, plain: str | None) -> tuple[str | None, list[str], list[str], str | None]:
    """(canonical, candidates, titles to search with, the first to search with)."""
    found: list[str] = []
    explicit: set[str] = set()

    def put(value: str) -> str | None:
        if not is_title(value):
            return None
        if all(same(value) != same(f) for f in found):
            found.append(value)
        return value

    years = frozenset(YEARS.findall(raw or ""))  # of the release, as words
    name = re.sub(r"[.\s]+", " ", head or "")
    own = [v for p in pieces(name) if (v := put(p))]
    if ALIAS.search(name):
        explicit |= {same(p) for p in pieces(name)}
    human: list[str] = []
    labels: list[str] = []
    for segment, inner in brackets(raw or ""):
        labels.append(label(segment, labels))
        # A season inside a field stands behind a name, in any script.
        seasoned = any(label(x) in ("season", "count") for x in inner)
        if labels[-1] in NO_TITLES and labels[-1] not in ("information", "genre", "credit", "disclaimer") or not (NATIVE.search(segment) or ALIAS.search(segment) or seasoned):
            continue
        if seasoned:
            explicit |= {same(p) for p in pieces(segment.split("|")[0])}
        if ALIAS.search(segment):
            explicit |= {same(p) for p in pieces(segment)}
        listed = [f for f in re.split(r"[|｜]", segment) if not any(p in f for p in PEOPLE)]  # names of people have slashes between them
        for field in (f for x in listed for f in re.split(r"\s+/\s+", x)):
            if is_field(tidy(field)) and not NATIVE.search(tidy(field)):
                continue
            human += [v for p in pieces(field, years) if (v := put(p))]
    before = (raw or "").split("[", 1)[0]
    if NATIVE.search(before):
        human += [v for p in pieces(before) if (v := put(p))]
    if not ALIAS.search(plain or ""):
        put(tidy(plain or ""))
    latin = lambda vs: [v for v in vs if LATIN.search(v) and not NATIVE.search(v)]
    # The first of two alias parts names a release, unless it is in another script.
    first = latin([v for p in pieces(ALIAS.split(name)[0]) if (v := p) and is_title(v)]) if ALIAS.search(name) else []
    choice = first or [v for v in latin(own) if len(v.split()) >= 2] or latin(own) or own
    best = choice[0] if choice else plain
    if best and YEAR.match(best) and human:  # a year alone says little
        best = (latin(human) or human)[0]
    search: list[str] = []
    usable = [v for v in found if not best or same(v) != same(best)]
    usable = [v for v in usable if NATIVE.search(v) or len(v.split()) >= 2 or same(v) in explicit]
    usable = [v for v in usable if v not in REGIONS and not (v in GENRES and len(usable) > 1)]
    for v in [*filter(NATIVE.search, usable), *(v for v in usable if not NATIVE.search(v))]:
        if len(search) < 4:
            search.append(v)
    primary = next(iter(filter(NATIVE.search, search)), best)
    return best, found, search, primary


TITLES = T.StructType([T.StructField("canonical", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("search", T.ArrayType(T.StringType())), T.StructField("primary", T.StringType())])


@F.pandas_udf(TITLES)
def title_info(head: pd.Series, raw: pd.Series, plain: pd.Series) -> pd.DataFrame:
    """Canonical title (Latin of two or more words, else Latin, else the first), candidates, at most four to search with
    (native ones first), and the first to search with. head: the release's name before its first marker."""
    return pd.DataFrame([titles_of(*x) for x in zip(head, raw, plain, strict=True)], columns=["canonical", "candidates", "search", "primary"])


@kept_apart
@F.pandas_udf(T.ArrayType(T.StringType()))
def field_labels(parts: pd.Series) -> pd.Series:
    """What each segment of a title says, in order (fields.label)."""

    def of(segments):
        if segments is None:
            return None
        labels: list[str] = []
        for s in segments:
            labels.append(label(s or "", labels))
        return labels

    return parts.map(of)
