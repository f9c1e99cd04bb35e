"""Policies that change over time: what each change makes of them, and which version a row fell under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATE = "struct<level:string,allow_max:double,reject_min:double>"


def policy_versions(changes: DataFrame, levels: dict[str, tuple[float, float]], medium: str = "medium") -> DataFrame:
    """``surface, at, until, enabled, level, allow_max, reject_min``: what holds from each change up to the next one.

    A change is ``(surface, at, seq, enabled, level, allow_max, reject_min)`` with nulls for what it leaves alone;
    changes of one time count by ``seq``, the last one holds. A known level sets both bounds and gives the name, an
    unknown one nothing. A number starts from the present bounds, or those of ``medium``: a reject bound without an allow
    bound moves both where no band lies between them, else it caps the allow bound; a stated allow bound stays. A number
    clears the name unless the bounds are still the level's. Disabling keeps bounds and name. Changes without a surface
    or a time are dropped.

    A known level leaves nothing of what was before but the switch, so changes are folded from one known level to the
    next, each such run in one row. What the days before bring to a day, one row for each, is added up by surface.
    """
    known = F.create_map(*(x for name, (lo, hi) in levels.items() for x in (F.lit(name), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))))

    def step(s: Column, c: Column) -> Column:
        named = known[c["level"]]
        lo, hi = F.coalesce(named["lo"], s["allow_max"]), F.coalesce(named["hi"], s["reject_min"])
        name = F.when(named.isNotNull(), c["level"]).otherwise(s["level"])
        base_lo, base_hi = F.coalesce(lo, F.lit(float(levels[medium][0]))), F.coalesce(hi, F.lit(float(levels[medium][1])))
        new_hi = F.coalesce(c["reject_min"], base_hi)
        moved = F.when(c["reject_min"].isNull(), base_lo).when(base_lo == base_hi, new_hi).otherwise(F.least(base_lo, new_hi))
        new_lo = F.coalesce(c["allow_max"], moved)
        number = c["reject_min"].isNotNull() | c["allow_max"].isNotNull()
        same = (known[name]["lo"] == new_lo) & (known[name]["hi"] == new_hi)
        return F.struct(
            F.when(number & ~F.coalesce(same, F.lit(False)), None).otherwise(name).alias("level"),
            F.when(number, new_lo).otherwise(lo).alias("allow_max"), F.when(number, new_hi).otherwise(hi).alias("reject_min"),
        )

    start = F.struct(F.lit(None).cast("string").alias("level"), F.lit(None).cast("double").alias("allow_max"), F.lit(None).cast("double").alias("reject_min")).cast(_STATE)
    version = f"struct<at:timestamp,until:timestamp,enabled:boolean,state:{_STATE}>"

    def add(acc: Column, c: Column) -> Column:
        now = step(acc["now"], c)
        return F.struct(now.alias("now"), F.array_append(acc["out"], F.struct(c["at"].alias("at"), c["until"].alias("until"), c["on"].alias("enabled"), now.alias("state"))).alias("out")).cast(f"struct<now:{_STATE},out:array<{version}>>")

    def block(acc: Column, some: Column) -> Column:
        own = F.aggregate(some, F.struct(acc["now"].alias("now"), F.array().cast(f"array<{version}>").alias("out")), add)
        return F.struct(own["now"].alias("now"), F.array_append(acc["out"], own["out"]).alias("out")).cast(made)

    made = f"struct<now:{_STATE},out:array<array<{version}>>>"
    order = [F.col("at").cast("timestamp").alias("at"), "seq", F.col("enabled").cast("boolean").alias("enabled"), F.col("level").cast("string").alias("level"), F.col("allow_max").cast("double").alias("allow_max"), F.col("reject_min").cast("double").alias("reject_min")]
    rows = changes.where("surface is not null and at is not null").select("surface", F.struct(*order).alias("c")).withColumn("day", F.floor(F.unix_micros("c.at") / 86_400_000_000).cast("long"))
    reset = F.coalesce(known[F.col("c.level")].isNotNull(), F.lit(False)).cast("long")
    days = rows.groupBy("surface", "day").agg(F.sum(reset).alias("n"), F.max(F.when(F.col("c.enabled").isNotNull(), F.col("c")))["enabled"].alias("on"), F.min("c.at").alias("first"))
    each, past = Window.partitionBy("surface").orderBy("day"), Window.partitionBy("surface").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("surface", "day", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("runs"), F.last("on", ignorenulls=True).over(past).alias("was"), F.lead("first").over(each).alias("next"))
    own = Window.partitionBy("surface", "day").orderBy("c")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"run": F.sum(reset).over(upto), "on": F.last("c.enabled", ignorenulls=True).over(upto), "until": F.lead("c.at").over(own)}).join(days, ["surface", "day"])
    row = F.struct("c", F.coalesce("until", "next").alias("until"), F.coalesce("on", "was", F.lit(True)).alias("on"))
    runs = rows.groupBy("surface", (F.col("runs") + F.col("run")).alias("run")).agg(F.array_sort(F.collect_list(row)).alias("c"))
    told = F.transform("c", lambda x: F.struct(x["c"]["at"].alias("at"), x["until"].alias("until"), x["on"].alias("on"), *(x["c"][k].alias(k) for k in ("level", "allow_max", "reject_min"))))
    # 512 at a time, so that no list that grows by appending gets long
    starts = F.sequence(F.lit(0), F.floor((F.size("c") - 1) / 512).cast("int"))
    runs = runs.select("surface", told.alias("c"), starts.alias("b"))
    folded = F.aggregate(F.transform("b", lambda b: F.slice("c", b * 512 + 1, F.lit(512))), F.struct(start.alias("now"), F.array().alias("out")).cast(made), block)["out"]
    out = runs.select("surface", F.explode(F.flatten(folded)).alias("v")).select("surface", "v.at", "v.until", "v.enabled", "v.state.*")
    return out.where(F.col("until").isNull() | (F.col("at") < F.col("until"))).select("surface", "at", "until", "enabled", "level", "allow_max", "reject_min")


def as_of(rows: DataFrame, versions: DataFrame, time: str = "ts", seconds: int = 86_400) -> DataFrame:
    """The rows with the version of their surface that held at their time, nulls where none did.

    Versions ``(surface, at, until, ...)`` do not overlap. Both sides are put in order of time by surface and stretch of
    ``seconds``, and a row takes the last version before it: no row is held against versions that it does not need, and
    a surface with most of the rows is still many keys. A version stands in each stretch that it touches, up to the last
    one that has rows. Late rows are dealt with like all others: time decides, not arrival.
    """
    stretch = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000)).cast("long")
    first, last = rows.agg(F.min(stretch(F.col(time).cast("timestamp"))), F.max(stretch(F.col(time).cast("timestamp")))).first()
    if first is None:
        first = last = 0
    said = [c for c in versions.columns if c != "surface"]
    own = versions.where("surface is not null and at is not null and (until is null or at < until)")
    own = own.select(F.col("surface").alias("_surface"), F.col("at").cast("timestamp").alias("_at"), F.struct(F.col("until").cast("timestamp").alias("_until"), *said).alias("_version"))
    low, high = F.greatest(stretch(F.col("_at")), F.lit(first)), F.least(F.coalesce(stretch(F.col("_version._until")), F.lit(last)), F.lit(last))
    own = own.where(low <= high).withColumn("_stretch", F.explode(F.sequence(low, high)))
    at, whole = F.col(time).cast("timestamp"), F.struct(*rows.columns)
    timed = F.col("surface").isNotNull() & F.col(time).isNotNull()
    keyed = rows.where(timed).select(F.col("surface").alias("_surface"), at.alias("_at"), stretch(at).alias("_stretch"), whole.alias("_row"))
    order = Window.partitionBy("_surface", "_stretch").orderBy("_at", F.col("_row").isNotNull())
    both = own.unionByName(keyed, allowMissingColumns=True).withColumn("_version", F.last("_version", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    holds = F.col("_version._until").isNull() | (F.col("_at") < F.col("_version._until"))
    found = both.where("_row is not null").select("_row.*", F.when(holds, F.col("_version")).alias("_version"))
    found = found.unionByName(rows.where(~timed), allowMissingColumns=True)
    return found.select(*rows.columns, *[F.col(f"_version.{c}").alias(c if c not in rows.columns else f"policy_{c}") for c in said])
