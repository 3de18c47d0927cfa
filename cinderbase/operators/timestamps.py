"""Mixed timestamp notations to one UTC instant.

``interpret`` lists every valid reading of a text as (order, micros, prior): a slash date can be read
day first or month first, a wall time inside an autumn change denotes two instants. Where the source
has declared its order, the reading with the smallest prior (that order, the first of two instants) is
the value. For a source that declares none, a Viterbi pass over its records picks one reading per value.
Its costs are the prior, a penalty for switching the order between records and a smaller one for going
back in time. The prior of a declared order outweighs both, so the pass could not change those values.

The Viterbi pass is distributed. Records of a source are cut into blocks by ``ingest_seq``; each
block is reduced to its min-plus matrix between the readings of its first and last record, the
matrices of a source are chained (one small row per block), and each block is solved again between
the readings so fixed. No task ever holds a whole source.

Defined cases: null values give no row; a text that denotes no real time keeps a row with null
``utc_micros``; a wall time that is skipped moves forward by the gap; a date is its first instant; a
missing client or zone means UTC and month first. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbase.session import ship

# Zone abbreviations with their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "JST": 540, "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660, "NPT": 345, "IST": 330, "BRT": -180,
}
# Month names in English, German, Spanish and French.
MONTHS = (
    ("january", "januar", "jänner", "enero", "janvier"),
    ("february", "februar", "febrero", "février"),
    ("march", "märz", "marzo", "mars"),
    ("april", "abril", "avril"),
    ("may", "mai", "mayo"),
    ("june", "juni", "junio", "juin"),
    ("july", "juli", "julio", "juillet"),
    ("august", "agosto", "août"),
    ("september", "sept", "septiembre", "septembre"),
    ("october", "oktober", "octubre", "octobre"),
    ("november", "noviembre", "novembre"),
    ("december", "dezember", "diciembre", "décembre"),
)
MONTH_OF = {name: i + 1 for i, names in enumerate(MONTHS) for name in names}
for _i, _names in enumerate(MONTHS):
    for _name in _names:
        for _cut in (_name[:3], _name[:4]):
            if not any(other.startswith(_cut) for _j, others in enumerate(MONTHS) if _j != _i for other in others):
                MONTH_OF.setdefault(_cut, _i + 1)

ZONE = r"(?:\s*(?P<zone>(?:(?:UTC|GMT)?\s?[+-]\d{2}:?(?:\d{2})?(?:\[[\w/+-]+\])?)|Z|[A-Z]{2,5}|\[?[A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?\]?))?"
CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<half>[ap])\.?m\.?(?![A-Za-z]))?(?:\s*(?:Uhr|h))?" + ZONE
DAYTIME = rf"(?:(?:[T_]|,?\s+(?:um |at )?){CLOCK})?"
SHAPES = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){DAYTIME}", re.I)),
    ("compact", re.compile(rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})(?:[T ]?(?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{ZONE})?", re.I)),
    ("slash", re.compile(rf"(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}}){DAYTIME}", re.I)),
    ("dotted", re.compile(rf"(?P<d>\d{{1,2}})\.\s?(?P<mo>\d{{1,2}})\.\s?(?P<y>\d{{4}}){DAYTIME}", re.I)),
    ("day_name", re.compile(rf"(?:[^\W\d]+\.?,\s+)?(?P<d>\d{{1,2}})\.?[\s-](?:de )?(?P<name>[^\W\d]+)\.?,?[\s-](?:de )?(?P<y>\d{{4}}){DAYTIME}", re.I)),
    ("name_day", re.compile(rf"(?:[^\W\d]+\.?,\s+)?(?P<name>[^\W\d]+)\.?\s(?P<d>\d{{1,2}}),?\s(?P<y>\d{{4}}){DAYTIME}", re.I)),
]
NUMBER = re.compile(r"(\d+)(?:\.(\d+))?")
EPOCH = datetime(1970, 1, 1)
LOW_US, HIGH_US = 946_684_800_000_000, 4_102_444_800_000_000

#: A reading against the declared order; the second of two instants; a switch of the order; a jump back in time.
DECLARED_COST, SECOND_COST, SWITCH_COST, BACK_COST = 3.0, 0.1, 1.0, 0.01


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001  an unknown name is no zone
        return None


def _micros(wall: datetime, offset_minutes: float) -> int:
    gap = wall - EPOCH
    return (gap.days * 86400 + gap.seconds) * 1_000_000 + gap.microseconds - round(offset_minutes * 60_000_000)


def _instants(wall: datetime, zone_text: str | None, default_zone: str | None) -> list[int]:
    """All instants of a wall time, the first one first; none if its zone is unknown."""
    text = (zone_text or "").strip()
    zone: ZoneInfo | None = None
    if m := re.fullmatch(r"(?:UTC|GMT)?\s?([+-])(\d{2}):?(\d{2})?(?:\[.*\])?", text, re.I):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 18 or minutes > 59:
            return []
        return [_micros(wall, (hours * 60 + minutes) * (1 if m[1] == "+" else -1))]
    if "/" in text:
        zone = _zone(text.strip("[]"))
        if zone is None:
            return []
    elif text:
        offset = ABBREVIATIONS.get(text.upper())
        return [] if offset is None else [_micros(wall, offset)]
    else:
        zone = _zone(default_zone or "UTC")
        if zone is None:
            return []
    first = wall.replace(tzinfo=zone, fold=0).utcoffset().total_seconds() / 60
    second = wall.replace(tzinfo=zone, fold=1).utcoffset().total_seconds() / 60
    # in a gap the offset before the change applies, which moves the time forward by the gap
    return [_micros(wall, first)] + ([_micros(wall, second)] if second < first else [])


def interpret(raw: str | None, zone: str | None, day_first: bool | None) -> tuple[str, list[tuple[str, int, float]]]:
    """The notation and all readings (order, micros, prior) of a text; no reading if it is no real time."""
    text = unicodedata.normalize("NFKC", raw or "").strip()
    if not text:
        return "none", []
    if (m := NUMBER.fullmatch(text)) and not (len(m[1]) in (8, 14) and m[2] is None):
        whole, part = m[1], m[2] or ""
        for unit, scale in (("epoch_s", 6), ("epoch_ms", 3), ("epoch_us", 0)):
            value = int(whole) * 10**scale + int((part + "0" * scale)[:scale] or 0)
            if LOW_US <= value < HIGH_US:
                return unit, [("", value, 0.0)]
        return "none", []
    for shape, pattern in SHAPES:
        m = pattern.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        if shape == "slash":
            a, b = int(g["a"]), int(g["b"])
            declared = None if day_first is None else ("D" if day_first else "M")
            dates = [("D", b, a), ("M", a, b)]
            dates = [(o, mo, d, DECLARED_COST if declared and o != declared else 0.0) for o, mo, d in dates]
        elif "name" in g:
            month = MONTH_OF.get(g["name"].lower())
            if month is None:
                continue
            dates = [("", month, int(g["d"]), 0.0)]
        else:
            dates = [("", int(g["mo"]), int(g["d"]), 0.0)]
        readings: list[tuple[str, int, float]] = []
        for order, month, day, prior in dates:
            hour, half = int(g.get("h") or 0), (g.get("half") or "").lower()
            if half:
                if not 1 <= hour <= 12:
                    continue
                hour = hour % 12 + (12 if half == "p" else 0)
            try:
                wall = datetime(int(g["y"]), month, day, hour, int(g.get("mi") or 0), int(g.get("s") or 0), int(((g.get("f") or "") + "000000")[:6]))
            except ValueError:
                continue
            for k, micros in enumerate(_instants(wall, g.get("zone"), zone)):
                if not any(r[1] == micros for r in readings):
                    readings.append((order, micros, prior + k * SECOND_COST))
        return shape, readings
    return "none", []


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen: dict = {}
        rows = []
        for raw, zone, first in zip(pdf["raw"], pdf["zone_id"], pdf["day_first"]):
            key = (raw, zone if isinstance(zone, str) else None, None if first is None or pd.isna(first) else bool(first))
            if key not in seen:
                seen[key] = interpret(*key)
            rows.append(seen[key])
        out = pdf[["ingest_seq", "field_name", "client"]].copy()
        out["declared"] = pdf["day_first"].notna()
        out["notation"] = [n for n, _ in rows]
        out["orders"] = [[r[0] for r in rs] for _, rs in rows]
        out["micros"] = [[r[1] for r in rs] for _, rs in rows]
        out["priors"] = [[r[2] for r in rs] for _, rs in rows]
        yield out


READ_SCHEMA = "ingest_seq long, field_name string, client string, declared boolean, notation string, orders array<string>, micros array<long>, priors array<double>"


def _step(prev: tuple, cur: tuple, i: int, j: int) -> float:
    cost = cur[2][j]
    if prev[0][i] and cur[0][j] and prev[0][i] != cur[0][j]:
        cost += SWITCH_COST
    if cur[1][j] < prev[1][i]:
        cost += BACK_COST
    return cost


def _records(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple]]:
    pdf = pdf.sort_values(["ingest_seq", "field_name"], kind="stable", na_position="first").reset_index(drop=True)
    return pdf, [(list(o), list(m), list(p)) for o, m, p in zip(pdf["orders"], pdf["micros"], pdf["priors"])]


def viterbi(records: list[tuple], start: int | None = None, end: int | None = None) -> list[int]:
    """The cheapest reading of each record, with the first and last fixed where given."""
    if not records:
        return []
    inf = float("inf")
    cost = [p if start is None or i == start else inf for i, p in enumerate(records[0][2])]
    back: list[list[int]] = []
    for prev, cur in zip(records, records[1:]):
        options = [[c + _step(prev, cur, i, j) for i, c in enumerate(cost)] for j in range(len(cur[1]))]
        back.append([min(range(len(o)), key=o.__getitem__) for o in options])
        cost = [min(o) for o in options]
    at = min(range(len(cost)), key=cost.__getitem__) if end is None else end
    path = [at]
    for links in reversed(back):
        at = links[at]
        path.append(at)
    return path[::-1]


def _summarise(pdf: pd.DataFrame) -> pd.DataFrame:
    """The min-plus matrix of a block between the readings of its first and last record."""
    pdf, records = _records(pdf)
    inf, first, matrix = float("inf"), records[0], []
    for start in range(len(first[1])):
        cost = [p if i == start else inf for i, p in enumerate(first[2])]
        for prev, cur in zip(records, records[1:]):
            cost = [min(c + _step(prev, cur, i, j) for i, c in enumerate(cost)) for j in range(len(cur[1]))]
        matrix.extend(cost)
    last = records[-1]
    return pd.DataFrame({
        "client": [pdf["client"][0]], "block": [pdf["block"][0]], "matrix": [matrix], "first_orders": [first[0]], "first_micros": [first[1]],
        "last_orders": [last[0]], "last_micros": [last[1]], "alone": [len(records) == 1],
    })


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fix the readings at the ends of each block of a source."""
    pdf = pdf.sort_values("block").reset_index(drop=True)
    stages: list[tuple] = []  # of each end: orders, micros, cost of reaching it from the end before
    for row in pdf.itertuples():
        stages.append((list(row.first_orders), list(row.first_micros), None))
        stages.append((list(row.last_orders), list(row.last_micros), list(row.matrix)))
    cost = [0.0] * len(stages[0][1])
    back = []
    for prev, cur in zip(stages, stages[1:]):
        n, m = len(prev[1]), len(cur[1])
        if cur[2] is not None:
            options = [[cost[i] + cur[2][i * m + j] for i in range(n)] for j in range(m)]
        else:
            free = (cur[0], cur[1], [0.0] * m)  # the prior of a first record is in its block's matrix
            options = [[cost[i] + _step(prev, free, i, j) for i in range(n)] for j in range(m)]
        back.append([min(range(n), key=o.__getitem__) for o in options])
        cost = [min(o) for o in options]
    at = min(range(len(cost)), key=cost.__getitem__)
    path = [at]
    for links in reversed(back):
        at = links[at]
        path.append(at)
    path = path[::-1]
    return pd.DataFrame({"client": pdf["client"], "block": pdf["block"], "start": path[0::2], "end": path[1::2]})


def _solve(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    if pdf.empty:
        return pd.DataFrame({c: [] for c in ("ingest_seq", "field_name", "client", "notation", "utc_micros", "ambiguous")})
    pdf, records = _records(pdf)
    start, end = (int(ends["start"][0]), int(ends["end"][0])) if len(ends) else (None, None)
    path = viterbi(records, start, end)
    out = pdf[["ingest_seq", "field_name", "client", "notation"]].copy()
    out["utc_micros"] = [r[1][k] for r, k in zip(records, path)]
    out["ambiguous"] = [len(r[1]) > 1 for r in records]
    return out


SOLVED = "ingest_seq long, field_name string, client string, notation string, utc_micros long, ambiguous boolean"


def normalise(memories: DataFrame, clients: DataFrame, fields: tuple[str, ...] = ("valid_from", "valid_until"), block_rows: int = 50_000, declared: bool = True) -> DataFrame:
    """One row per non-null value: ``ingest_seq, field_name, client, notation, utc_micros, ambiguous``.

    With ``declared=False`` the orders of day and month that the clients declare are not used.
    """
    ship(memories.sparkSession)
    # one row per client; the reference table may repeat one
    c = clients.groupBy(F.col("client").alias("_client")).agg(F.min("zone_id").alias("zone_id"), F.min("day_first").alias("day_first"), F.lit(True).alias("known"))
    values = memories.select(
        F.col("ingest_seq").cast("long").alias("ingest_seq"),
        "client",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields])).alias("v"),
    ).where("v.raw IS NOT NULL")
    values = values.join(c, F.col("client") == F.col("_client"), "left").select(
        "ingest_seq", "v.field_name", "client", "v.raw", F.coalesce("zone_id", F.lit("UTC")).alias("zone_id"),
        (F.when(F.col("known"), F.col("day_first")).otherwise(F.lit(False)) if declared else F.lit(None).cast("boolean")).alias("day_first"),
    )
    read = lambda rows: rows.mapInPandas(_read, READ_SCHEMA).withColumn("client", F.coalesce("client", F.lit("")))
    # readings are compared only among values that have an order of day and month, or several instants, and whose source declares no order
    chained = ~F.col("declared") & ((F.size("micros") > 1) | ((F.size("micros") == 1) & (F.get("orders", F.lit(0)) != "")))
    first = (F.array_position("priors", F.array_min("priors")) - 1).cast("int")
    plain = read(values).where(~chained).select(
        "ingest_seq", "field_name", "client", "notation", F.when(F.size("micros") > 0, F.get("micros", first)).alias("utc_micros"), (F.size("micros") > 1).alias("ambiguous")
    )
    records = read(values.where("day_first IS NULL")).where(chained).withColumn("block", F.coalesce(F.floor(F.col("ingest_seq") / block_rows), -1 - F.pmod(F.xxhash64("field_name", "micros", "notation"), F.lit(1024))))
    summaries = records.groupBy("client", "block").applyInPandas(
        _summarise, "client string, block long, matrix array<double>, first_orders array<string>, first_micros array<long>, last_orders array<string>, last_micros array<long>, alone boolean"
    )
    ends = summaries.groupBy("client").applyInPandas(_chain, "client string, block long, start int, end int")
    solved = records.groupBy("client", "block").cogroup(ends.groupBy("client", "block")).applyInPandas(_solve, SOLVED)
    return plain.unionByName(solved).withColumn("client", F.nullif("client", F.lit("")))
