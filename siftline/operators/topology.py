"""Feature blocks of residue tables: surface composition, patch topology and charge topology, one row per structure.

A residue table has ``structure_id``, ``residue_id`` (long), ``resname``, ``aa``, ``x``, ``y``, ``z`` and ``is_cdr``.
Everything is aggregation and equi-joins by structure; contact edges come from grid cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.conditions import residue_charge
from siftline.operators import graph
from siftline.tables import require_columns

# Classes of residues, and the class pairs whose contacts are counted.
CLASSES = {"positive": ("resname", ("LYS", "ARG", "HIS")), "negative": ("resname", ("ASP", "GLU")), "hydrophobic": ("aa", tuple("AILMFWYVC")), "aromatic": ("aa", tuple("FWY"))}
CONTACTS = (("hydrophobic", "positive"), ("hydrophobic", "negative"), ("aromatic", "positive"), ("aromatic", "negative"), ("positive", "negative"))
PH = (6.0, 7.4)
KEY, NODE, XYZ = "structure_id", "residue_id", ("x", "y", "z")


def member(name: str) -> Column:
    column, values = CLASSES[name]
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def regions() -> dict[str, Column]:
    return {"all": F.lit(True), "cdr": F.col("is_cdr"), "framework": ~F.col("is_cdr")}


def number(condition: Column) -> Column:
    return F.count_if(condition).cast("double")


def aligned_positions(frame: DataFrame, key: str, aligned: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, position, is_region): ungapped positions of an aligned sequence and whether they lie in a window.

    The running count of residues is a window over one sequence's own characters.
    """
    chars = frame.select(key, F.posexplode(F.split(aligned, "")).alias("at", "c")).filter("c <> '-' and c <> ''")
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.lit(False)
    for a, b in windows.values():
        inside = inside | ((F.col("at") >= a) & (F.col("at") < b))
    return chars.select(key, (F.sum(F.lit(1)).over(order) - 1).cast("long").alias("position"), inside.alias("is_region"))


def surface_residues(residues: DataFrame, radius: float = 10.0, quantile: float = 0.45) -> DataFrame:
    """Residues with few neighbours; all of a structure where none has. Adds ``region_bin``."""
    flagged = graph.surface_flags(residues, KEY, NODE, XYZ, radius, quantile)
    some = F.max("is_surface").over(Window.partitionBy(KEY))
    kept = flagged.withColumn("some", some).filter(F.col("is_surface") | ~F.col("some")).drop("some", "is_surface", "n_near")
    return kept.withColumn("region_bin", F.when(F.col("is_cdr"), "cdr").otherwise("framework"))


def surface_composition(residues: DataFrame) -> DataFrame:
    """29 features that do not use the spatial arrangement: one aggregation."""
    require_columns(residues, KEY, "resname", "aa", "is_cdr")
    out = [F.count("*").cast("double").alias("surface_residue_count"), F.avg(F.col("is_cdr").cast("double")).alias("surface_cdr_fraction")]
    for region, inside in regions().items():
        n = number(inside)
        out.append(n.alias(f"surface_{region}_residue_count"))
        for name in CLASSES:
            count = number(inside & member(name))
            out += [count.alias(f"surface_{region}_{name}_count"), F.try_divide(count, F.nullif(n, F.lit(0.0))).alias(f"surface_{region}_{name}_fraction")]
    return residues.groupBy(KEY).agg(*out)


def _patches(residues: DataFrame, edges: DataFrame, selected: dict[str, Column]) -> DataFrame:
    """(structure_id, class, n_patches, largest, mean_size, largest_cdr): components of each class's own subgraph.

    All classes at once: a structure and class is one group of the component step.
    """
    marked = residues.select(KEY, NODE, "is_cdr", F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in selected.items()])).alias("class")).filter("class is not null")
    nodes = marked.select(F.concat_ws("|", KEY, "class").alias("part"), NODE, KEY, "class", "is_cdr")
    ends = marked.select(KEY, F.col(NODE).alias("src"), "class")
    both = edges.join(ends, [KEY, "src"]).join(marked.select(KEY, F.col(NODE).alias("dst"), "class"), [KEY, "dst", "class"])
    labels = graph.component_labels(nodes, both.select(F.concat_ws("|", KEY, "class").alias("part"), "src", "dst"), "part", NODE)
    met = labels.join(nodes, ["part", NODE])
    sizes = met.groupBy(KEY, "class", "component").agg(F.count("*").alias("size"), F.avg(F.col("is_cdr").cast("double")).alias("share"))
    top = F.max(F.struct("size", (-F.col("component")).alias("first"), "share"))
    return sizes.groupBy(KEY, "class").agg(F.count("*").cast("double").alias("n_patches"), F.max("size").cast("double").alias("largest"), F.avg("size").alias("mean_size"), top["share"].alias("largest_cdr"))


def _wide(patches: DataFrame, names: dict[str, tuple[dict[str, str], bool]]) -> DataFrame:
    """One row per structure: columns of each class under the names given; counts and sizes are 0 where there is none."""
    out = []
    for name, (columns, _) in names.items():
        for column, alias in columns.items():
            value = F.max(F.when(F.col("class") == name, F.col(column)))
            out.append((value if column == "largest_cdr" else F.coalesce(value, F.lit(0.0))).alias(alias))
    return patches.groupBy(KEY).agg(*out)


def topology_features(residues: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """50 features of the contact graph: its size, patches of each class, contacts and centroids of class pairs."""
    edges = graph.contact_edges(residues, KEY, NODE, XYZ, cutoff)
    selected = {n: member(n) for n in CLASSES}
    names = {n: ({"n_patches": f"{n}_patch_count", "largest": f"{n}_largest_patch_size", "mean_size": f"{n}_mean_patch_size", "largest_cdr": f"{n}_largest_patch_cdr_fraction"}, True) for n in CLASSES}
    patches = _wide(_patches(residues, edges, selected), names)
    base = [F.count("*").cast("double").alias("surface_graph_nodes")]
    for n in CLASSES:
        base += [number(inside & member(n)).alias(f"{n}_{r}_selected_count") for r, inside in regions().items()]
    for a, b in CONTACTS:
        gaps = [F.avg(F.when(member(a), F.col(c))) - F.avg(F.when(member(b), F.col(c))) for c in XYZ]
        base.append(F.sqrt(sum((g * g for g in gaps), F.lit(0.0))).alias(f"{a}_{b}_centroid_distance"))
    whole = residues.groupBy(KEY).agg(*base)
    flags = residues.select(KEY, NODE, *[member(n).alias(n) for n in CLASSES])
    left = flags.select(KEY, F.col(NODE).alias("src"), *[F.col(n).alias(f"s_{n}") for n in CLASSES])
    right = flags.select(KEY, F.col(NODE).alias("dst"), *[F.col(n).alias(f"d_{n}") for n in CLASSES])
    met = edges.join(left, [KEY, "src"]).join(right, [KEY, "dst"])
    contact = {(a, b): (F.col(f"s_{a}") & F.col(f"d_{b}")) | (F.col(f"s_{b}") & F.col(f"d_{a}")) for a, b in CONTACTS}
    counts = met.groupBy(KEY).agg(F.count("*").cast("double").alias("surface_graph_edges"), *[number(c).alias(f"{a}_{b}_adjacent_edge_count") for (a, b), c in contact.items()])
    joined = whole.join(counts, KEY, "left").join(patches, KEY, "left")
    zero = [c for c in joined.columns if c != KEY and not c.endswith(("_fraction", "_distance"))]
    joined = joined.fillna(0.0, zero)
    more = {"surface_graph_mean_degree": 2 * F.col("surface_graph_edges") / F.greatest(F.col("surface_graph_nodes"), F.lit(1.0))}
    for n in CLASSES:
        more[f"{n}_patch_fragmentation"] = F.col(f"{n}_patch_count") / F.greatest(F.col(f"{n}_all_selected_count"), F.lit(1.0))
    for a, b in CONTACTS:
        more[f"{a}_{b}_adjacent_edge_fraction"] = F.col(f"{a}_{b}_adjacent_edge_count") / F.greatest(F.col("surface_graph_edges"), F.lit(1.0))
    return joined.withColumns(more)


def charge_topology(residues: DataFrame, ph_values: tuple[float, ...] = PH, cutoff: float = 10.0) -> DataFrame:
    """Four counts and 16 charge features for each pH of each structure's surface: 36 with two."""
    surface = surface_residues(residues)
    totals = residues.groupBy(KEY).agg(F.count("*").cast("double").alias("structure_residue_count"))
    middle = surface.groupBy(KEY).agg(F.count("*").cast("double").alias("surface_proxy_residue_count"), *[F.avg(c).alias(f"m{c}") for c in XYZ])
    out = totals.join(middle, KEY).select(KEY, F.lit(1.0).alias("structure_available"), "structure_residue_count", "surface_proxy_residue_count", (F.col("surface_proxy_residue_count") / F.col("structure_residue_count")).alias("surface_proxy_fraction"))
    edges = graph.contact_edges(surface, KEY, NODE, XYZ, cutoff)
    for ph in ph_values:
        p = f"pH{str(ph).replace('.', 'p')}"
        q = residue_charge(F.col("resname"), F.lit(ph))
        rows = surface.join(middle, KEY).withColumn("q", q)
        q, size = F.col("q"), F.abs(F.col("q"))
        total = F.sum(size)
        radial = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in XYZ), F.lit(0.0)))

        def centre(c: str, sign: int, q: Column = q, size: Column = size) -> Column:
            own = F.when(q * sign > 0, size)
            return F.try_divide(F.sum(own * F.col(c)), F.sum(own))

        gap = [centre(c, 1) - centre(c, -1) for c in XYZ]
        pull = [F.sum(q * (F.col(c) - F.col(f"m{c}"))) / F.greatest(total, F.lit(1.0)) for c in XYZ]
        some = F.count_if(size > 0) > 0
        sums = rows.groupBy(KEY).agg(
            F.sum(q).alias(f"{p}_surface_net_charge"),
            F.coalesce(F.sum(F.when(q > 0, q)), F.lit(0.0)).alias(f"{p}_surface_positive_charge"),
            F.coalesce(F.sum(F.when(q < 0, q)), F.lit(0.0)).alias(f"{p}_surface_negative_charge"),
            total.alias(f"{p}_surface_abs_charge"),
            (F.coalesce(F.sum(F.when(F.col("is_cdr"), size)), F.lit(0.0)) / F.greatest(total, F.lit(1.0))).alias(f"{p}_surface_cdr_charge_fraction"),
            F.sqrt(sum((g * g for g in gap), F.lit(0.0))).alias(f"{p}_positive_negative_centroid_distance"),
            F.when(some, F.sqrt(sum((g * g for g in pull), F.lit(0.0)))).alias(f"{p}_charge_dipole_proxy"),
            F.when(some, F.var_pop(F.when(size > 0, radial))).alias(f"{p}_charge_radial_variance_proxy"),
        )
        charge = residue_charge(F.col("resname"), F.lit(ph))
        names = {s: ({"n_patches": f"{p}_{s}_patch_count", "largest": f"{p}_largest_{s}_patch_size", "largest_cdr": f"{p}_largest_{s}_patch_cdr_fraction", "mean_size": f"{p}_{s}_patch_mean_size"}, True) for s in ("positive", "negative")}
        patches = _wide(_patches(surface, edges, {"positive": charge > 0, "negative": charge < 0}), names)
        out = out.join(sums, KEY).join(patches, KEY, "left").fillna(0.0, [f"{p}_{x}" for s in ("positive", "negative") for x in (f"{s}_patch_count", f"largest_{s}_patch_size", f"{s}_patch_mean_size")])
    return out


def with_missing_structures(names: DataFrame, features: DataFrame, name: str) -> DataFrame:
    """Every name with the features of its structure (lower-cased name); without one ``structure_available`` is 0."""
    met = names.withColumn(KEY, F.lower(F.col(name))).join(features, KEY, "left")
    return met.withColumn("structure_available", F.coalesce("structure_available", F.lit(0.0)))
