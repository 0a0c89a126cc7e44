"""Timestamps as text, in many layouts, precisions and zones, to one UTC instant.

Every text is reduced to a character-class shape mask (digit 9, month name M, weekday D, am/pm P, other
words w, the ISO letters T and Z). A mask is mapped to a parser once; all texts of a batch that share
a mask are then taken apart by one Arrow regular expression, and local times become instants through
zone transition tables (`transitions`), looked up by binary search. Nothing is parsed row by row. The tables are of
one stated version of the zone data (`zone_data`), which the driver reads and the tasks get as data, so that what
zone files a worker has plays no part.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import importlib.util
import io
import re
import zoneinfo
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of months and weekdays.
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY = r"(?:mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
#: Zone names that mean UTC wherever they stand.
UTC_NAMES = {"utc", "z", "zulu", "ut"}
#: Seconds in the units of an age; a month counts 30 days and a year 365.
AGES = {"s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "wk": 604800, "wks": 604800, "week": 604800, "weeks": 604800, "mo": 2592000, "month": 2592000, "months": 2592000, "y": 31536000, "yr": 31536000, "year": 31536000, "years": 31536000}

_FIRST, _LAST = -(1 << 62), dt.datetime(2100, 1, 1, tzinfo=dt.UTC)


class ZoneData(NamedTuple):
    """The compiled zone files of one release, by zone name."""

    version: str
    files: dict[str, bytes]


#: Zone data larger than this is refused; a whole release has about half a megabyte.
MOST_BYTES = 8 << 20


@lru_cache(maxsize=8)
def zone_data(version: str | None = None, root: str | None = None) -> ZoneData:
    """The zone data in folder `root`, or in the first of the system's folders that has any, or of the installed
    package; ValueError if `version` is given and isn't the release found there. A folder that names no release counts as
    a digest of its contents."""
    folders = [Path(p) for p in ([root] if root else zoneinfo.TZPATH)]
    if not root and importlib.util.find_spec("tzdata"):
        folders.append(Path(importlib.util.find_spec("tzdata").origin).parent / "zoneinfo")
    top = next((f for f in folders if (f / "Etc/UTC").exists() or (f / "UTC").exists()), None)
    if top is None:
        raise ValueError("no zone data found")
    names = sorted(zoneinfo.available_timezones()) if not root else sorted(str(p.relative_to(top)) for p in top.rglob("*") if p.is_file())
    files = {n: b for n in names if (top / n).is_file() and (b := (top / n).read_bytes())[:4] == b"TZif"}
    if sum(map(len, files.values())) > MOST_BYTES:
        raise ValueError(f"over {MOST_BYTES} bytes of zone data")
    found = None
    if (p := top / "tzdata.zi").exists() and (m := re.match(r"# version (\S+)", p.read_text(errors="replace"))):
        found = m.group(1)
    elif (p := top / "+VERSION").exists():
        found = p.read_text().strip()
    found = found or hashlib.sha256(b"".join(n.encode() + files[n] for n in sorted(files))).hexdigest()[:12]
    if version is not None and version != found:
        raise ValueError(f"zone data is of version {found}, not {version}")
    return ZoneData(found, files)


class Transitions(NamedTuple):
    """A zone's table: offset `offsets[i]` (seconds) holds for local times before `local[i]` and from `local[i-1]` on.

    `local[i]` is the last reading of the wall clock under the old offset: a time that occurs twice is its
    first occurrence, and one that is skipped is read with the offset before the change."""

    local: np.ndarray
    offsets: np.ndarray
    names: np.ndarray  # lower-case abbreviations of the periods


#: Tables made in this process, by version and zone.
_tables: dict[tuple[str, str], Transitions | None] = {}


def transitions(zone: str, data: ZoneData | None = None) -> Transitions:
    """The transition table of a zone from 1970 to 2100, found by bisection; raises KeyError for no zone."""
    data = data or zone_data()
    key = (data.version, zone)
    if key not in _tables:
        _tables[key] = _transitions(zone, data.files[zone]) if zone in data.files else None
    if _tables[key] is None:
        raise KeyError(zone)
    return _tables[key]


def _transitions(zone: str, compiled: bytes) -> Transitions:
    z = zoneinfo.ZoneInfo.from_file(io.BytesIO(compiled), key=zone)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    at_ = lambda s: (epoch + dt.timedelta(seconds=s)).astimezone(z)
    off = lambda s: int(at_(s).utcoffset().total_seconds())
    at, end, step = 0, int((_LAST - epoch).total_seconds()), 7 * 86400
    local, offsets, names, now = [], [], [(at_(0).tzname() or "").lower()], off(0)
    while at < end:
        nxt = at + step
        if off(nxt) != now:
            change = at + bisect.bisect_left(range(step), True, key=lambda k: off(at + k) != now)
            after = off(change)
            local.append(change + max(now, after))
            offsets.append(now)
            names.append((at_(change).tzname() or "").lower())
            now = after
            at = change
            continue
        at = nxt
    return Transitions(np.array(local, dtype=np.int64), np.array([*offsets, now], dtype=np.int64), np.array(names, dtype=object))


def to_utc(local_seconds: np.ndarray, zone: str, data: ZoneData | None = None, names: np.ndarray | None = None) -> np.ndarray:
    """Seconds since 1970 UTC of local times. `names`: the lower-case abbreviations beside them, "" for none: one that only
    the second occurrence of a time bears means that one."""
    t = transitions(zone, data)
    k = np.searchsorted(t.local, local_seconds, side="right")
    if names is not None and len(t.local):
        at, nxt = np.minimum(k, len(t.local) - 1), np.minimum(k + 1, len(t.offsets) - 1)
        twice = (k < len(t.local)) & (local_seconds >= t.local[at] - t.offsets[k] + t.offsets[nxt])
        k = np.where(twice & (t.names[nxt] == names) & (t.names[k] != names), nxt, k)
    return local_seconds - t.offsets[k]


def shape_masks(texts: pa.Array) -> pa.Array:
    """Character-class shapes of lower-case, stripped texts."""
    m = texts
    for pattern, to in (
        (rf"\b{_MONTH}\b", "M"),
        (rf"\b{_DAY}\b", "D"),
        (r"([0-9] ?)[ap]\.?m\b\.?", r"\1P"),
        (r"([0-9])t([0-9])", r"\1T\2"),
        (r"([0-9])z$", r"\1Z"),
        (r"[0-9]", "9"),
        (r"[a-zµ]+", "w"),
    ):
        m = pc.replace_substring_regex(m, pattern, to)
    return m


_TIME = r"(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]+))?)?(?: ?(?P<ap>[ap])\.?m\b\.?)?"
_ZONE = r"(?: ?(?:(?P<z>z)|(?P<off>[+-][0-9]{2}:?(?:[0-9]{2})?)(?:\[[^\]]*\])?|\[?(?P<zn>[a-z]+(?:[/_+-][a-z_0-9]+)*)\]?))?"
_M_TIME = r"9{1,2}:99(:99([.,]9+)?)?( ?P)?"
_M_ZONE = r"(Z| ?[+-]99:?(99)?(\[[^\]]*\])?| ?\[?w([/_+-]+w)*\]?)?"
_SEP = r"[T ,]{1,2}"
_TSEP = r"(?:t|,? )"
#: (mask, kind, text): the first mask that fits decides; groups are named after what they hold.
_LAYOUTS: tuple[tuple[str, str, str], ...] = (
    (r"9{8}T9{6}" + _M_ZONE, "civil", r"(?P<y>[0-9]{4})(?P<mo>[0-9]{2})(?P<d>[0-9]{2})t(?P<h>[0-9]{2})(?P<mi>[0-9]{2})(?P<s>[0-9]{2})" + _ZONE),
    (rf"9999[-/.]99?[-/.]99?({_SEP}{_M_TIME}{_M_ZONE})?", "civil", rf"(?P<y>[0-9]{{4}})[-/.](?P<mo>[0-9]{{1,2}})[-/.](?P<d>[0-9]{{1,2}})(?:{_TSEP}{_TIME}{_ZONE})?"),
    (rf"99?[-/.]99?[-/.](9999|99)({_SEP}{_M_TIME}{_M_ZONE})?", "ordered", rf"(?P<a>[0-9]{{1,2}})[-/.](?P<b>[0-9]{{1,2}})[-/.](?P<c>[0-9]{{4}}|[0-9]{{2}})(?:{_TSEP}{_TIME}{_ZONE})?"),
    (rf"(D,? )?99?[ -]M[ -]9999({_SEP}{_M_TIME}{_M_ZONE})?", "mail", rf"(?:[a-z]+,? )?(?P<d>[0-9]{{1,2}})[ -](?P<mon>[a-z]{{3}})[a-z]*[ -](?P<y>[0-9]{{4}})(?:{_TSEP}{_TIME}{_ZONE})?"),
    (rf"(D,? )?M 99?,? 9999({_SEP}{_M_TIME}{_M_ZONE})?", "civil", rf"(?:[a-z]+,? )?(?P<mon>{_MONTH}) (?P<d>[0-9]{{1,2}}),? (?P<y>[0-9]{{4}})(?:{_TSEP}{_TIME}{_ZONE})?"),
    (r"9{9,10}([.]9*)?", "epoch1", r"(?P<n>[0-9]+)(?:\.(?P<f>[0-9]*))?"),
    (r"9{12,13}([.]9*)?", "epoch1000", r"(?P<n>[0-9]+)(?:\.[0-9]*)?"),
    (r"9{15,16}", "epoch1000000", r"(?P<n>[0-9]+)"),
    (r"9{18,19}", "epoch1000000000", r"(?P<n>[0-9]+)"),
    (r"(w:? )?(9+ ?w|w w) w", "age", r"(?:[a-z]+:? )?(?:(?P<n>[0-9]+) ?|(?P<one>an?|one) )(?P<u>[a-z]+) ago"),
)


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> tuple[str, str] | None:
    """(kind, regular expression) for a mask, or None when such texts name no instant."""
    return next(((kind, rf"^{text}$") for shape, kind, text in _LAYOUTS if re.fullmatch(shape, mask)), None)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_MONTH_DAYS = np.array([0, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def parse_instants(texts: pd.Series, received: np.ndarray, zones: np.ndarray, orders: np.ndarray, data: ZoneData | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(milliseconds since 1970 UTC, whether the text names an instant), for texts with the second of receipt
    and the home zone and date order of the node that received them."""
    n = len(texts)
    out, ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    arr = pc.utf8_lower(pc.utf8_trim_whitespace(pc.fill_null(pa.Array.from_pandas(texts, type=pa.string()), "")))
    codes = pc.dictionary_encode(shape_masks(arr))
    index, masks = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
    by_mask = np.argsort(index, kind="stable")
    starts = np.searchsorted(index[by_mask], np.arange(len(masks) + 1))
    for k, mask in enumerate(masks):
        how = parser_of(mask)
        if how is None:
            continue
        rows = by_mask[starts[k] : starts[k + 1]]
        kind, regex = how
        parts = pc.extract_regex(arr.take(pa.array(rows)), regex)
        fit = ~pc.is_null(parts).to_numpy(zero_copy_only=False)
        if not fit.all():
            rows, parts = rows[fit], parts.filter(pa.array(fit))
        if not len(rows):
            continue
        names = {parts.type.field(i).name for i in range(parts.type.num_fields)}
        word = lambda g: parts.field(g) if g in names else None

        def number(g: str, default: int = 0) -> np.ndarray:
            a = word(g)
            if a is None:
                return np.full(len(rows), default, dtype=np.int64)
            return pc.cast(pc.if_else(pc.equal(pc.fill_null(a, ""), ""), str(default), pc.fill_null(a, str(default))), pa.int64()).to_numpy(zero_copy_only=False)

        def millis(g: str) -> np.ndarray:
            a = word(g)
            if a is None:
                return np.zeros(len(rows), dtype=np.int64)
            return pc.cast(pc.utf8_slice_codeunits(pc.utf8_rpad(pc.fill_null(a, ""), 3, "0"), 0, 3), pa.int64()).to_numpy(zero_copy_only=False)

        if kind.startswith("epoch"):
            per = int(kind[5:])
            v = number("n")
            out[rows] = v * 1000 + millis("f") if per == 1 else v // (per // 1000)
            ok[rows] = out[rows] >= 86_400_000
            continue
        if kind == "age":
            unit = pd.Series(word("u").to_pandas()).map(AGES)
            good = unit.notna().to_numpy()
            out[rows] = (received[rows] - number("n", 1) * unit.fillna(0).to_numpy().astype(np.int64)) * 1000
            ok[rows] = good
            continue
        valid = np.ones(len(rows), dtype=bool)
        if kind == "ordered":
            a, b, c = number("a"), number("b"), number("c")
            order = pd.Series(orders[rows], dtype=object).fillna("ymd").to_numpy().astype(str)
            wide = np.array(pc.utf8_length(word("c")).to_pylist()) == 4
            dmy, ymd = order == "dmy", (order == "ymd") & ~wide
            y = np.where(ymd, a, c)
            mo = np.where(dmy, b, np.where(ymd, b, a))
            d = np.where(dmy, a, np.where(ymd, c, b))
            # Year last although the node writes it first: only month and day are open, month comes first.
            y = np.where(y < 100, 2000 + y, y)
        else:
            y, d = number("y"), number("d")
            mo = pd.Series(word("mon").to_pandas()).str[:3].map(MONTHS).fillna(0).to_numpy().astype(np.int64) if "mon" in names else number("mo")
        h, mi, s = number("h"), number("mi"), number("s")
        if "ap" in names:
            ap = pc.fill_null(word("ap"), "").to_pylist()
            p, am = np.array([x == "p" for x in ap]), np.array([x == "a" for x in ap])
            valid &= ~((p | am) & ((h < 1) | (h > 12)))
            h = np.where(p & (h < 12), h + 12, np.where(am & (h == 12), 0, h))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        valid &= (y > 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (h <= 24) & (mi < 60) & (s <= 60)
        m12 = np.clip(mo, 1, 12)
        valid &= d <= np.where((m12 == 2) & ~leap, 28, _MONTH_DAYS[m12])
        days = _days(y, m12, d)
        valid &= days != 0
        local = days * 86400 + h * 3600 + mi * 60 + s
        home = pd.Series(zones[rows], dtype=object).fillna("UTC").to_numpy().astype(str)
        utc = np.zeros(len(rows), dtype=bool)
        abbreviations = None
        if "z" in names:
            utc |= np.array([x == "z" for x in pc.fill_null(word("z"), "").to_pylist()])
        shift = np.zeros(len(rows), dtype=np.int64)
        if "off" in names:
            off = pc.fill_null(word("off"), "").to_pylist()
            if any(off):
                table = {o: (1 if o[0] == "+" else -1) * (int(o[1:3]) * 3600 + int(o[3:].lstrip(":") or 0) * 60) if o else 0 for o in set(off)}
                shift = np.array([table[o] for o in off], dtype=np.int64)
                utc |= np.array([bool(o) for o in off])
        if "zn" in names:
            zn = pc.fill_null(word("zn"), "").to_pylist()
            for name in set(zn) - {""}:
                here = np.array([x == name for x in zn])
                if name in UTC_NAMES or (kind == "mail" and name == "gmt"):
                    utc |= here
                elif "/" in name:
                    known = _zone_name(name, data or zone_data())
                    home = np.where(here, known or "", home)
                    valid &= ~here | (known is not None)
                else:  # an abbreviation: the zone of the node
                    if abbreviations is None:
                        abbreviations = np.full(len(rows), "", dtype=object)
                    abbreviations[here] = name
        seconds = np.where(utc, local - shift, 0)
        for zone in set(home[~utc]):
            here = ~utc & (home == zone)
            try:
                seconds[here] = to_utc(local[here], zone, data, None if abbreviations is None else abbreviations[here])
            except KeyError:
                valid &= ~here
        out[rows] = seconds * 1000 + millis("f")
        ok[rows] = valid
    return out, ok


#: Names of zones by their lower-case form, by version.
_lower: dict[str, dict[str, str]] = {}


def _zone_name(name: str, data: ZoneData) -> str | None:
    if data.version not in _lower:
        _lower[data.version] = {z.lower(): z for z in data.files}
    return _lower[data.version].get(name)


def instants(items: DataFrame, collectors: DataFrame, text: str = "posted_at", received: str = "received_at", key: str = "item_id", data: ZoneData | None = None) -> DataFrame:
    """(key, posted_ms) of every row whose `text` names an instant and isn't already YYYY-MM-DDTHH:MM:SSZ.

    `collectors` gives home_zone and date_order by node_id; a node that it lacks, or null, counts as UTC
    with the year first. `data` is the zone data to use, by default the driver's; all tasks get the same, half a megabyte.
    A time that occurs twice is its first occurrence, but the second where its abbreviation is only that one's. Defined edge cases: null, empty, filler and impossible dates give no row, as do
    the year 1 and 1970-01-01; an age without a time of receipt gives no row; an unknown zone name with a
    slash gives no row; repeated rows each give theirs. The join's right side is a list of nodes and is
    broadcast only below Spark's own threshold; else nothing is shuffled.
    """
    d = items.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(received).cast("timestamp").alias("received"), "node_id")
    d = d.where(F.col("text").isNotNull() & ~F.col("text").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"))
    nodes = collectors.select("node_id", "home_zone", "date_order")
    d = d.join(nodes, "node_id", "left")
    d = d.where(~(F.col("received").isNull() & F.lower("text").like("%ago%")))
    shared = items.sparkSession.sparkContext.broadcast(data or zone_data())

    @F.pandas_udf(T.LongType())
    def posted_ms(text: pd.Series, received: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
        ms, ok = parse_instants(text, received.fillna(0).to_numpy().astype(np.int64), zone.to_numpy(), order.to_numpy(), shared.value)
        return pd.Series(pd.array(ms, dtype="Int64")).where(ok)

    ms = posted_ms("text", F.unix_seconds("received"), "home_zone", "date_order")
    return d.select(F.col("key").alias(key), ms.alias("posted_ms")).where("posted_ms is not null")
