"""Tags, ARRAY<STRUCT<k, v>> in stored order: filters and classifiers as higher-order expressions, without Python on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import HIGHWAY, PLACE, RAILWAY

#: A filter: clauses (key, values); no values means any.
Clauses = Sequence[tuple[str, Sequence[str]]]
WAY_FILTER: Clauses = (("highway", ()), ("railway", ("rail", "light_rail", "narrow_gauge")), ("natural", ("water", "wood")), ("landuse", ("forest", "grass", "meadow")), ("leisure", ("park",)), ("building", ()))
RELATION_FILTER: Clauses = (("natural", ("water", "wood")), ("landuse", ("forest", "grass", "meadow")), ("leisure", ("park",)), ("building", ()), ("type", ("multipolygon",)), ("admin_level", ("2",)))


def matches(tags: Column, clauses: Clauses) -> Column:
    """True if any clause is met by any tag."""

    def one(t: Column) -> Column:
        out = F.lit(False)
        for key, values in clauses:
            test = t["k"] == key
            out = out | (test & t["v"].isin(*values) if values else test)
        return out

    return F.exists(tags, one)


def has(tags: Column, key: str, value: str) -> Column:
    return F.exists(tags, lambda t: (t["k"] == key) & (t["v"] == value))


def _lookup(value: Column, table: Mapping[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value)


def first_value(tags: Column, key: str) -> Column:
    return F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"]


def last_value(tags: Column, key: str) -> Column:
    return F.get(F.reverse(F.filter(tags, lambda t: t["k"] == key)), F.lit(0))["v"]


def first_kind(tags: Column, kind_of: object) -> Column:
    """kind_of(tag) of the first tag in stored order that has one."""
    return F.get(F.array_compact(F.transform(tags, kind_of)), F.lit(0))


def area_of(t: Column) -> Column:
    k, v = t["k"], t["v"]
    return F.when((k == "natural") & (v == "water"), 0).when(k == "building", 3).when(((k == "natural") & (v == "wood")) | ((k == "landuse") & (v == "forest")), 1).when(((k == "landuse") & v.isin("grass", "meadow")) | ((k == "leisure") & (v == "park")), 2)


def road_of(t: Column) -> Column:
    return F.when(t["k"] == "highway", _lookup(t["v"], HIGHWAY)).when(t["k"] == "railway", _lookup(t["v"], RAILWAY))


def classify_way(tags: Column) -> Column:
    """STRUCT<shape, kind> of the first tag that gives a road or an area; null if none does."""
    one = lambda t: F.when(road_of(t).isNotNull(), F.struct(F.lit("road").alias("shape"), road_of(t).alias("kind"))).when(area_of(t).isNotNull(), F.struct(F.lit("area").alias("shape"), area_of(t).alias("kind")))
    return first_kind(tags, one)


def classify_relation(tags: Column) -> Column:
    return first_kind(tags, area_of)


def classify_place(tags: Column) -> Column:
    """The first place tag decides; an unknown value is no label."""
    return _lookup(first_value(tags, "place"), PLACE)


def classify_poi(tags: Column) -> Column:
    return F.when(has(tags, "highway", "traffic_signals"), 0)


def structure_of(tags: Column) -> Column:
    """1 bridge, else 2 tunnel, else 0; the value `no` doesn't count."""
    on = lambda key: F.exists(tags, lambda t: (t["k"] == key) & (t["v"] != "no"))
    return F.when(on("bridge"), 1).when(on("tunnel"), 2).otherwise(0)


def layer_of(tags: Column) -> Column:
    return F.coalesce(F.trim(first_value(tags, "layer")).try_cast("tinyint").cast("int"), F.lit(0))


def way_layer(tags: Column) -> Column:
    """A layer of 0 becomes 1 on bridges and -1 in tunnels."""
    s = structure_of(tags)
    return F.when(layer_of(tags) != 0, layer_of(tags)).when(s == 1, 1).when(s == 2, -1).otherwise(0)


def name_of(tags: Column) -> Column:
    return F.get(F.filter(tags, lambda t: (t["k"] == "name") & (t["v"] != "")), F.lit(0))["v"]


def lanes_of(tags: Column) -> Column:
    """STRUCT<forward, backward>: explicit counts first, else what they leave of the total, else the total split with the odd lane forward; one way has one side only."""

    def count(key: str) -> Column:
        n = F.trim(last_value(tags, key)).try_cast("int")
        return F.when(n.between(0, 255), n)

    total, fwd, bwd = count("lanes"), count("lanes:forward"), count("lanes:backward")
    way = F.coalesce(F.trim(last_value(tags, "oneway")), F.lit(""))
    ahead, back = way.isin("yes", "true", "1"), way.isin("-1", "reverse")
    one = F.greatest(F.coalesce(total, F.lit(1)), F.lit(1))
    f = F.coalesce(fwd, F.when(bwd.isNotNull() & total.isNotNull(), F.greatest(total - bwd, F.lit(0))), F.when(total.isNotNull(), F.floor((total + 1) / 2).cast("int")), bwd, F.lit(1))
    b = F.coalesce(bwd, F.when(fwd.isNotNull() & total.isNotNull(), F.greatest(total - fwd, F.lit(0))), F.when(total.isNotNull(), F.floor(total / 2).cast("int")), fwd, F.lit(1))
    zero = F.lit(0)
    return F.struct(F.when(ahead, F.greatest(F.coalesce(fwd, one), F.lit(1))).when(back, zero).otherwise(F.greatest(f, F.lit(1))).alias("forward"), F.when(back, F.greatest(F.coalesce(bwd, one), F.lit(1))).when(ahead, zero).otherwise(F.greatest(b, F.lit(1))).alias("backward"))


def floors_of(tags: Column) -> Column:
    levels = first_value(tags, "building:levels").try_cast("double")
    return F.coalesce(F.when(levels.isNotNull() & ~F.isnan(levels), F.greatest(F.lit(1.0), F.least(F.lit(255.0), F.round(levels)))), F.lit(1.0)).cast("int")


def area_label(kind: Column) -> Column:
    """Label class of a named area: water, or park for forest and grass."""
    return F.when(kind == 0, 6).when(kind.isin(1, 2), 7)


def is_ring(refs: Column) -> Column:
    return (F.size(refs) >= 4) & (F.get(refs, F.lit(0)) == F.element_at(refs, -1))


def edge_state(junction: Column, cut: Column) -> Column:
    """0 connected, 1 disconnected, 2 cut at a tile's border."""
    return F.when(cut, 2).when(junction, 0).otherwise(1)


def caps(start: Column, end: Column, structure: Column) -> Column:
    return start.bitwiseOR(F.shiftleft(end, 2)).bitwiseOR(F.shiftleft(structure, 4))
