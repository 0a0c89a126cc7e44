"""Queries of the rule engine, with a small configuration of product classes and text signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import values
from marketloom.operators import rules
from marketloom.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Patterns keep to what Java and RE2 both read alike.
PROFILES = (
    rules.Profile("gpu", (r"\bgpu\b", r"graphics (card|adapter)", r"video card"), none=("motherboard",), variants=(rules.Variant("24gb", (r"\b24 ?gb?\b", r"\b24576mb\b")), rules.Variant("16gb", (r"\b16 ?gb?\b", r"\b16384mb\b"))), priority=2),
    rules.Profile("ssd", (r"\bssd\b", r"\bnvme\b", r"solid state drive"), variants=(rules.Variant("2tb", (r"\b2 ?tb\b", r"\b2,?000 ?gb\b", r"\b2 terabyte\b")),), variant_required=True, priority=1),
    rules.Profile("drive", (r"drive\b", r"\bhdd\b"), all=(r"[0-9]",)),
    rules.Profile("monitor", (r"monitor", r"led screen", r"ips display")),
)
GROUPS = (
    rules.Group("reposted", (r"\breposted\b", r"\bprice drop\b")),
    rules.Group("clearance", (r"\bclearance\b",), profiles=("monitor", "gpu")),
    rules.Group("hype", (r"l@@k", r"must see", r"hot deal"), weight=0.3),
    rules.Group("unsealed", (r"\boem box\b", r"\bopen box\b"), weight=0.2, kinds=("marketplace", "local")),
)
DAMAGE = rules.Group("damage", (r"\bdented\b", r"\bbent\b", r"\bbroken\b", r"\bfaded\b", r"\bcoil whine\b"), weight=0.4, negatable=True)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _m(patterns) -> str:
    return "regexp_matches(t, '(?i)" + "|".join(f"({p})" for p in patterns) + "')"


def _profile_sql(p: rules.Profile) -> str:
    out = [_m(p.any), *(_m((a,)) for a in p.all), *([f"NOT {_m(p.none)}"] if p.none else [])]
    if p.variant_required:
        out.append("(" + " OR ".join(_m(v.any) for v in p.variants) + ")")
    return " AND ".join(out)


_GPU, _SSD, _DRIVE, _MONITOR = PROFILES


@query(f"""
    WITH x AS (SELECT item_id, title AS t FROM deal_items), y AS (SELECT item_id, t, {_profile_sql(_GPU)} AS g, {_profile_sql(_SSD)} AS s, {_profile_sql(_DRIVE)} AS d, {_profile_sql(_MONITOR)} AS m FROM x)
    SELECT item_id, CASE WHEN g THEN 'gpu' WHEN s THEN 'ssd' WHEN d THEN 'drive' WHEN m THEN 'monitor' END AS profile,
      CASE WHEN g THEN CASE WHEN {_m(_GPU.variants[0].any)} THEN '24gb' WHEN {_m(_GPU.variants[1].any)} THEN '16gb' END WHEN s THEN '2tb' END AS variant
    FROM y""")
def classify_products(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "deal_items").select("item_id", rules.identify(F.col("title"), PROFILES).alias("p"))
    return i.select("item_id", "p.profile", "p.variant")


@query(f"""
    WITH x AS (SELECT item_id, title AS t, source_kind FROM deal_items), y AS (SELECT *, CASE WHEN {_profile_sql(_GPU)} THEN 'gpu' WHEN {_profile_sql(_SSD)} THEN 'ssd' WHEN {_profile_sql(_DRIVE)} THEN 'drive' WHEN {_profile_sql(_MONITOR)} THEN 'monitor' END AS p FROM x)
    SELECT item_id, CASE WHEN {_m(GROUPS[0].patterns)} THEN 'reposted' WHEN {_m(GROUPS[1].patterns)} AND p IN ('monitor', 'gpu') THEN 'clearance' END AS rejected_by,
      round(1 - (CASE WHEN {_m(GROUPS[2].patterns)} THEN 0.7 ELSE 1 END) * (CASE WHEN {_m(GROUPS[3].patterns)} AND source_kind IN ('marketplace', 'local') THEN 0.8 ELSE 1 END), 6) AS joint
    FROM y""")
def rule_groups(spark: SparkSession, d: str) -> DataFrame:
    i = rules.classified(load(spark, d, "deal_items"), F.col("title"), PROFILES, GROUPS, F.col("source_kind"))
    return i.select("item_id", "rejected_by", F.round(values.noisy_or(F.transform("signals", lambda s: s["weight"])), 6).alias("joint"))


#: Descriptions that speak of damage in one way or another, and whether they state it.
_CLAIMS = (
    ("is dented", True), ("is not dented", False), ("no box dented corner", True), ("no dented, bent or broken parts", False), ("no dents, bent or broken parts", True), ("not bent, broken screen", True), ("dented: none", False), ("bent? no returns", True), ("never broken but dented", True), ("isn''t broken", False),
    ("works. nothing else", False), ("no coil whine, no broken pins", False), ("not dented or faded", False), ("it is no longer new, broken", True), ("broken - never", False), ("faded", True), ("no warranty though bent", True),
)


@query(f"SELECT item_id, list_value({', '.join(str(b).lower() for _, b in _CLAIMS)})[(item_id % {len(_CLAIMS)}) + 1] AS damaged FROM deal_items")
def negation_match(spark: SparkSession, d: str) -> DataFrame:
    """Damage stated and not denied, in a list of cases, one with each item's number."""
    said = F.get(F.array(*(F.lit(a.replace("''", "'")) for a, _ in _CLAIMS)), (F.col("item_id") % len(_CLAIMS)).cast("int"))
    return load(spark, d, "deal_items").select("item_id", rules.group_match(F.concat(F.lit("Item "), "item_id", F.lit(". "), said), DAMAGE).alias("damaged"))


@query()
def damage_stated(spark: SparkSession, d: str) -> DataFrame:
    """Damage stated and not denied in the items' own descriptions."""
    return load(spark, d, "deal_items").select("item_id", rules.group_match(F.col("description"), DAMAGE).alias("damaged"))


