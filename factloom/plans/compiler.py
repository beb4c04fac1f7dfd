"""A parsed query as one lazily built DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import spatial
from factloom.plans.language import Both, Compare, Not, Query


class PlanError(ValueError):
    """A query that parses but can't be planned."""


@dataclass(frozen=True)
class Binding:
    """What a source name stands for."""

    geo_attr: str
    scalar_attr: str


def compare(item: Compare, value: dict[str, Column]) -> Column:
    """Two-valued comparison with the first visible fact of the attribute; absent or of another kind is false."""
    literal, kind = item.literal, value["kind"]
    if literal.number is not None:
        x, y = value["num"], F.lit(literal.number)
        tests = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}
        if item.op not in tests:
            return F.lit(False)
        # not-a-number differs from everything and compares with nothing
        test = F.when(F.isnan(x), F.lit(item.op == "!=")).otherwise(tests[item.op])
        return F.coalesce(test & kind.isin(C.F64, C.I64, C.TIME, C.BOOL), F.lit(False))
    x, y = value["v_str"], F.lit(literal.text)
    tests = {"=": x == y, "!=": x != y, "~": F.contains(x, y)}
    return F.coalesce(tests[item.op] & (kind == C.SYM), F.lit(False)) if item.op in tests else F.lit(False)


def condition(node: object, values: dict[str, dict[str, Column]]) -> Column:
    if isinstance(node, Both):
        left, right = condition(node.left, values), condition(node.right, values)
        return left & right if node.op == "and" else left | right
    if isinstance(node, Not):
        return ~condition(node.inner, values)
    return compare(node, values[node.field])


def boxes(query: Query, place: tuple[float, float] | None = None) -> list[spatial.Box]:
    """Boxes outside of which no position matters to the query's spatial clauses; none if it has none."""
    if query.bbox is not None:
        return [query.bbox]
    at = _place(query, place)
    return spatial.radius_boxes(*at, query.within.metres) if at is not None else []


def entities(
    facts: DataFrame, query: Query, binding: Binding, valid_at: int, sys_at: int, now: int, place: tuple[float, float] | None = None, by_space: bool = True
) -> DataFrame:
    """The visible positions of passing entities, with their sort key and scalar, unordered.

    With ``by_space`` a spatial clause first selects the entities that have a position in its
    boxes, by key ranges and whole coordinates that reach the scan; only their facts are
    aggregated. The outcome is the same without.

    Each entity's first values are aggregated before the shuffle, so an entity with very many
    facts sends a row per task; positions are then joined to the entities that pass. Only the
    attributes that the query reads take part (``since`` looks at all of them), and only the
    fields that it compares, which keeps the aggregation in fixed-width buffers.
    """
    texts = {c.field for c in query.comparisons() if c.literal.number is None}
    wanted = list(dict.fromkeys([binding.geo_attr, binding.scalar_attr, *query.fields()]))
    seen = facts.where(C.visible(valid_at, sys_at))
    read = seen if query.since is not None else seen.where(F.col("attr").isin(*wanted))
    rows = seen.where((F.col("attr") == binding.geo_attr) & (F.col("kind") == C.GEO))
    if by_space and (about := boxes(query, place)):
        found = rows.where(spatial.about_boxes(about))
        read = read.join(found.select(F.col("entity").alias("e")).distinct(), F.col("entity") == F.col("e"), "left_semi")
        rows = found if query.bbox is not None else rows
    made: list[Column] = [F.min("fact_id").alias("entity_first"), F.max("valid_from").alias("latest")]
    values: dict[str, dict[str, Column]] = {}
    for i, name in enumerate(wanted):
        fields = {"kind": F.col("kind"), "num": C.number()}
        if name in texts:
            fields["v_str"] = F.col("v_str")
        if name == binding.geo_attr:
            fields |= {"v_lat_e7": F.col("v_lat_e7"), "v_lon_e7": F.col("v_lon_e7")}
        made += [F.min_by(column, F.when(F.col("attr") == name, F.col("fact_id"))).alias(f"first_{i}_{field}") for field, column in fields.items()]
        values[name] = {field: F.col(f"first_{i}_{field}") for field in fields}
    per = read.groupBy("entity").agg(*made)
    if query.since is not None:
        per = per.where(F.col("latest") >= query.since.resolve(now) - C.EPOCH_2000)
    if query.where is not None:
        per = per.where(condition(query.where, values))
    place = _place(query, place)
    if place is not None:
        geo = values[binding.geo_attr]
        apart = C.haversine_m(F.lit(place[0]), F.lit(place[1]), geo["v_lat_e7"] / 1e7, geo["v_lon_e7"] / 1e7)
        per = per.where((geo["kind"] == C.GEO) & (apart <= query.within.metres))
    kept = [F.col("entity").alias("e"), "entity_first", values[binding.scalar_attr]["num"].alias("scalar_value")]
    if query.order_by:
        kept.append(values[query.order_by]["num"].alias("sort_key"))
    if query.bbox is not None:
        rows = rows.where(spatial.in_box(query.bbox))
    return rows.select("entity", "fact_id", "v_lat_e7", "v_lon_e7").join(per.select(*kept), F.col("entity") == F.col("e")).drop("e")


def _place(query: Query, place: tuple[float, float] | None) -> tuple[float, float] | None:
    if query.within is None:
        return None
    if query.within.lat is not None:
        return query.within.lat, query.within.lon
    if place is None:
        raise PlanError(f"no gazetteer entry resolves the place {':'.join(query.within.place)}")
    return place


def points(rows: DataFrame, query: Query) -> DataFrame:
    """Result rows in order, a row per position, cut at the limit (a top-k where there is one)."""
    order = [F.col("entity_first"), F.col("fact_id")]
    if query.order_by:
        key = F.col("sort_key")
        order = [key.isNull(), key.desc() if query.descending else key.asc(), *order]
    out = rows.select(*(["sort_key"] if query.order_by else []), "entity_first", "entity", "fact_id", *spatial.as_point(F.col("scalar_value"))).orderBy(*order)
    if query.limit:
        out = out.limit(query.limit)
    return out.drop("sort_key", "entity_first")
