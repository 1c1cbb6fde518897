"""Neighbours, semantic edges, tag votes, poles and profiles on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import arrangements as arr
from lexweave.operators import connectivity as con
from lexweave.operators import edges as ed
from lexweave.operators import vectors as vec
from lexweave.plans.registry import Inputs, query

SIMS = """
    sims AS (
      SELECT a.id AS query_id, b.id AS neighbour_id, a.category_slug AS q_cat, b.category_slug AS n_cat,
             round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS score
      FROM v_vectors a, v_vectors b),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS rank
      FROM sims)"""


@query("knn_exact", "V1 K2", f"""
    WITH {SIMS}
    SELECT query_id, neighbour_id, score, rank FROM ranked WHERE rank <= 10""")
def knn_exact(t: Inputs):
    return vec.knn(t.v_vectors, t.v_vectors, 10)


@query("knn_within_category", "V1 V9", """
    WITH sims AS (
      SELECT a.id AS query_id, b.id AS neighbour_id,
             round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS score
      FROM v_vectors a JOIN v_vectors b ON a.category_slug = b.category_slug)
    SELECT query_id, neighbour_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS rank
    FROM sims WHERE score >= 0.1
    QUALIFY rank <= 5""")
def knn_within_category(t: Inputs):
    return vec.knn(t.v_vectors, t.v_vectors, 5, part_col="category_slug", min_sim=0.1)


EDGE_SQL = f"""
    WITH {SIMS},
    hits AS (
      SELECT *, q_cat = n_cat AS same_category FROM ranked
      WHERE rank <= 50 AND query_id <> neighbour_id
        AND score >= CASE WHEN q_cat = n_cat THEN 0.25 ELSE 0.20 END),
    capped AS (
      SELECT * FROM hits
      QUALIFY row_number() OVER (PARTITION BY query_id, same_category
                                 ORDER BY score DESC, neighbour_id)
              <= CASE WHEN same_category THEN 5 ELSE 10 END)
    SELECT least(query_id, neighbour_id) AS atom_a_id, greatest(query_id, neighbour_id) AS atom_b_id,
           CASE WHEN score >= 0.30 THEN 'resonates' ELSE 'evokes' END AS relationship_type,
           max(round(score, 3)) AS strength,
           max(CASE WHEN same_category THEN 'intra_category' ELSE 'cross_category' END) AS scope
    FROM capped GROUP BY 1, 2, 3"""


@query("semantic_edges", "V2 W3", EDGE_SQL)
def semantic_edges(t: Inputs):
    return ed.semantic_edges(
        t.v_vectors, cross=0.20, intra=0.25, resonates_from=0.30
    )


@query("semantic_edges_known", "V2", f"""
    SELECT e.* FROM ({EDGE_SQL}) e
    WHERE atom_a_id IN (SELECT id FROM v_atoms) AND atom_b_id IN (SELECT id FROM v_atoms)""")
def semantic_edges_known(t: Inputs):
    return ed.semantic_edges(t.v_vectors, t.v_atoms, cross=0.20, intra=0.25, resonates_from=0.30)


@query("upsert_edges", "U2", """
    WITH new AS (
      SELECT atom_a_id, atom_b_id, relationship_type, arrangement_scope, max(strength) AS strength,
             min(provenance) AS provenance
      FROM v_edge_events WHERE last_reinforced_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2, 3, 4),
    old AS (
      SELECT atom_a_id, atom_b_id, relationship_type, arrangement_scope, max(strength) AS strength,
             min(provenance) AS provenance, max(last_reinforced_at) AS last_reinforced_at
      FROM v_edge_events WHERE last_reinforced_at < TIMESTAMP '1998-01-01' GROUP BY 1, 2, 3, 4)
    SELECT coalesce(o.atom_a_id, n.atom_a_id) AS atom_a_id, coalesce(o.atom_b_id, n.atom_b_id) AS atom_b_id,
           coalesce(o.relationship_type, n.relationship_type) AS relationship_type,
           coalesce(o.arrangement_scope, n.arrangement_scope) AS arrangement_scope,
           greatest(coalesce(o.strength, 0), coalesce(n.strength, 0)) AS strength,
           coalesce(o.provenance, n.provenance) AS provenance,
           CAST(CASE WHEN n.atom_a_id IS NULL THEN o.last_reinforced_at
                ELSE TIMESTAMP '2002-01-01' END AS VARCHAR) AS last_reinforced_at
    FROM old o FULL JOIN new n ON o.atom_a_id = n.atom_a_id AND o.atom_b_id = n.atom_b_id
      AND o.relationship_type = n.relationship_type AND o.arrangement_scope = n.arrangement_scope""")
def upsert_edges(t: Inputs):
    cut = F.lit("1998-01-01").cast("timestamp")
    seen = F.col("last_reinforced_at")
    key = ed.EDGE_KEY
    agg = [F.max("strength").alias("strength"), F.min("provenance").alias("provenance"), F.max(seen).alias("last_reinforced_at")]
    old = t.v_edge_events.filter(seen < cut).groupBy(*key).agg(*agg)
    new = t.v_edge_events.filter(seen >= cut).groupBy(*key).agg(*agg)
    out = ed.upsert_max(old, new, F.lit("2002-01-01").cast("timestamp"))
    return out.withColumn("last_reinforced_at", F.date_format("last_reinforced_at", "yyyy-MM-dd HH:mm:ss"))


@query("edge_degree", "A10", """
    SELECT id, count(*) AS degree FROM (
      SELECT atom_a_id AS id FROM v_edges WHERE provenance = 'semantic'
      UNION ALL SELECT atom_b_id FROM v_edges WHERE provenance = 'semantic') GROUP BY id""")
def edge_degree(t: Inputs):
    return ed.edge_degree(t.v_edges)


@query("edge_endpoints", "U5", """
    SELECT atom_a_id AS id FROM v_edge_events UNION SELECT atom_b_id FROM v_edge_events""")
def edge_endpoints(t: Inputs):
    return ed.edge_endpoints(t.v_edge_events)


@query("edge_neighbours", "J3", """
    SELECT e.id, e.neighbour_id, e.relationship_type, e.arrangement_scope, e.strength, a.text AS neighbour_text
    FROM (SELECT atom_a_id AS id, atom_b_id AS neighbour_id, relationship_type, arrangement_scope, strength FROM v_edges
          UNION ALL
          SELECT atom_b_id, atom_a_id, relationship_type, arrangement_scope, strength FROM v_edges) e
    JOIN v_atoms a ON a.id = e.neighbour_id""")
def edge_neighbours(t: Inputs):
    return ed.edge_neighbours(t.v_edges.drop("provenance", "last_reinforced_at"), t.v_atoms)


@query("isolated_edges", "V5", f"""
    WITH {SIMS},
    busy AS (SELECT id FROM (SELECT atom_a_id AS id FROM v_edges WHERE provenance = 'semantic'
             UNION ALL SELECT atom_b_id FROM v_edges WHERE provenance = 'semantic')
             GROUP BY id HAVING count(*) >= 40)
    SELECT least(query_id, neighbour_id) AS atom_a_id, greatest(query_id, neighbour_id) AS atom_b_id,
           max(score) AS strength, 'resonates' AS relationship_type,
           'con:' || least(query_id, neighbour_id) || ':' || greatest(query_id, neighbour_id) AS id
    FROM ranked WHERE rank <= 8 AND query_id <> neighbour_id AND score >= 0.25
      AND query_id NOT IN (SELECT id FROM busy)
    GROUP BY 1, 2""")
def isolated_edges(t: Inputs):
    return ed.isolated_edges(t.v_vectors, ed.edge_degree(t.v_edges), min_sim=0.25, min_edges=40)


@query("propagate_tags", "V3", f"""
    WITH {SIMS},
    near AS (SELECT * FROM ranked WHERE rank <= 15 AND query_id <> neighbour_id AND score >= 0.2),
    size AS (SELECT query_id, count(*) AS neighbours FROM near GROUP BY 1),
    votes AS (SELECT query_id, tag_id, count(*) AS votes FROM near
              JOIN v_atom_tags ON atom_id = neighbour_id GROUP BY 1, 2)
    SELECT v.query_id AS atom_id, tag_id, votes, votes / neighbours AS confidence,
           CASE WHEN votes >= 3 THEN 'applied' ELSE 'ambiguous' END AS outcome
    FROM votes v JOIN size s ON v.query_id = s.query_id WHERE votes >= 2""")
def propagate_tags(t: Inputs):
    return con.propagate_tags(t.v_vectors, t.v_atom_tags, min_sim=0.2)


CENTRES = """
    centres AS (
      SELECT axis_slug, pole, list(x ORDER BY pos) AS centroid FROM (
        SELECT axis_slug, pole, pos, avg(x) AS x FROM (
          SELECT axis_slug, pole, unnest(vec::DOUBLE[]) AS x, generate_subscripts(vec, 1) AS pos
          FROM v_memberships JOIN v_vectors ON id = atom_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("pole_centroids", "A20", f"""
    WITH {CENTRES}
    SELECT axis_slug, pole, pos - 1 AS pos, round(x, 6) AS x FROM (
      SELECT axis_slug, pole, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS pos FROM centres)""")
def pole_centroids(t: Inputs):
    return con.centroids(t.v_memberships, t.v_vectors).select(
        "axis_slug", "pole", F.posexplode("centroid").alias("pos", "x")
    ).withColumn("x", F.round("x", 6))


@query("score_memberships", "V4", f"""
    WITH {CENTRES},
    scored AS (
      SELECT v.id AS atom_id, lo.axis_slug,
             round(list_cosine_similarity(v.vec::DOUBLE[], lo.centroid), 6) AS sim_low,
             round(list_cosine_similarity(v.vec::DOUBLE[], hi.centroid), 6) AS sim_high
      FROM v_vectors v, centres lo JOIN centres hi ON lo.axis_slug = hi.axis_slug
      WHERE lo.pole = 'low' AND hi.pole = 'high'),
    gaps AS (SELECT *, greatest(sim_low, sim_high) AS best, round(abs(sim_low - sim_high), 6) AS gap FROM scored)
    SELECT atom_id, axis_slug,
           CASE WHEN best >= 0.2 AND gap >= 0.1 THEN CASE WHEN sim_low > sim_high THEN 'low' ELSE 'high' END END AS pole,
           CASE WHEN best >= 0.2 AND gap >= 0.1 THEN 'assigned' ELSE 'ambiguous' END AS outcome, best, gap
    FROM gaps
    WHERE (best >= 0.2 AND gap >= 0.1) OR (best >= 0.1 AND best < 0.2) OR (best >= 0.2 AND gap < 0.1)""")
def score_memberships(t: Inputs):
    return con.score_memberships(
        t.v_vectors, con.centroids(t.v_memberships, t.v_vectors), sim=0.2, gap=0.1, band_low=0.1, band_high=0.2
    )


FLAGS = """
    deg AS (SELECT id, count(*) AS degree FROM (
      SELECT atom_a_id AS id FROM v_edges WHERE provenance = 'semantic'
      UNION ALL SELECT atom_b_id FROM v_edges WHERE provenance = 'semantic') GROUP BY id),
    flags AS (
      SELECT a.id, a.id IN (SELECT atom_id FROM v_atom_tags) AS has_tag,
             a.id IN (SELECT atom_id FROM v_memberships) AS has_pole,
             a.id IN (SELECT id FROM v_vectors) AS embedded, coalesce(degree, 0) AS degree
      FROM v_atoms a LEFT JOIN deg d ON a.id = d.id),
    checked AS (SELECT *, CASE WHEN has_tag AND has_pole AND degree >= 40 THEN 'skipped_full'
                   WHEN NOT embedded THEN 'skipped_unembedded' ELSE 'processed' END AS outcome
    FROM flags)"""


@query("skip_check", "V6", f"WITH {FLAGS} SELECT * FROM checked")
def skip_check(t: Inputs):
    return con.needs_work(t.v_atoms, t.v_vectors, t.v_atom_tags, t.v_memberships, ed.edge_degree(t.v_edges), 40)


PASS = f"""
    WITH {FLAGS}, {SIMS}, {CENTRES},
    work AS (SELECT * FROM v_vectors WHERE id IN (SELECT id FROM checked WHERE outcome = 'processed')),
    mine AS (SELECT * FROM ranked WHERE query_id IN (SELECT id FROM work)),
    votes AS (SELECT query_id AS atom_id, tag_id, count(*) AS votes FROM mine JOIN v_atom_tags ON atom_id = neighbour_id
      WHERE rank <= 15 AND query_id <> neighbour_id AND score >= 0.2 GROUP BY 1, 2 HAVING count(*) >= 2),
    scored AS (SELECT v.id AS atom_id, lo.axis_slug, round(list_cosine_similarity(v.vec::DOUBLE[], lo.centroid), 6) AS sim_low, round(list_cosine_similarity(v.vec::DOUBLE[], hi.centroid), 6) AS sim_high
      FROM work v, centres lo JOIN centres hi ON lo.axis_slug = hi.axis_slug WHERE lo.pole = 'low' AND hi.pole = 'high'),
    gaps AS (SELECT *, greatest(sim_low, sim_high) AS best, round(abs(sim_low - sim_high), 6) AS gap FROM scored),
    fresh AS (SELECT DISTINCT least(query_id, neighbour_id) AS a, greatest(query_id, neighbour_id) AS b FROM mine
      WHERE rank <= 8 AND score >= 0.25 AND query_id <> neighbour_id AND NOT starts_with(neighbour_id, 'doc_chunk_')
        AND query_id NOT IN (SELECT id FROM deg WHERE degree >= 40))
    SELECT 'atoms_' || outcome AS counter, count(*) AS n FROM checked GROUP BY outcome
    UNION ALL SELECT 'tags_applied', count(*) FROM votes WHERE votes >= 3 AND (atom_id, tag_id) NOT IN (SELECT (atom_id, tag_id) FROM v_atom_tags)
    UNION ALL SELECT 'tags_ambiguous', count(*) FROM votes WHERE votes < 3
    UNION ALL SELECT 'memberships_created', count(*) FROM gaps WHERE best >= 0.2 AND gap >= 0.1 AND (atom_id, axis_slug) NOT IN (SELECT (atom_id, axis_slug) FROM v_memberships)
    UNION ALL SELECT 'memberships_ambiguous', count(*) FROM gaps WHERE (best >= 0.1 AND best < 0.2) OR (best >= 0.2 AND gap < 0.1)
    UNION ALL SELECT 'edges_created', count(*) FROM fresh WHERE (a, b) NOT IN (SELECT (atom_a_id, atom_b_id) FROM v_edges WHERE relationship_type = 'resonates' AND arrangement_scope = '')"""


def counted(t: Inputs, batch):
    """The counters of a connectivity pass over a batch of ids."""
    return con.connectivity_pass(
        batch, t.v_vectors, t.v_atom_tags, t.v_memberships, t.v_edges,
        tag_sim=0.2, pole_sim=0.2, pole_gap=0.1, band_low=0.1, band_high=0.2, edge_sim=0.25, min_edges=40,
    )


@query("connectivity_pass", "V6", PASS)
def connectivity_pass(t: Inputs):
    return counted(t, t.v_atoms)


@query("redundancy", "V7", f"""
    WITH {SIMS}
    SELECT query_id AS id, arg_max(neighbour_id, -rank) AS similar_id, max(score) AS similarity
    FROM ranked WHERE rank <= 2 AND query_id <> neighbour_id
    GROUP BY 1 HAVING max(score) > 0.3""")
def redundancy(t: Inputs):
    return vec.redundancy(t.v_vectors, t.v_vectors, 0.3)


@query("semantic_search", "V9 J9", f"""
    WITH {SIMS}
    SELECT query_id, neighbour_id, score, rank, a.text, a.category_slug
    FROM ranked r JOIN v_atoms a ON a.id = r.neighbour_id
    WHERE rank <= 20 AND a.status <> 'rejected' AND a.category_slug IN ('size.small', 'line.promo')""")
def semantic_search(t: Inputs):
    atoms = t.v_atoms.select("id", "text", "category_slug", "status")
    return vec.semantic_search(
        t.v_vectors, t.v_vectors, atoms, categories=["size.small", "line.promo"]
    ).drop("status")


DIMS = ["hardness", "temperature", "weight", "formality", "era_affinity", "register"]
DIST = "sqrt(" + " + ".join(
    f"(coalesce(a.{d}, 0.5) - coalesce(p.{d}, 0.5)) * (coalesce(a.{d}, 0.5) - coalesce(p.{d}, 0.5))" for d in DIMS
) + ")"
TAGS_SQL = f"""
    SELECT atom_id, arrangement_slug, distance FROM (
      SELECT a.id AS atom_id, p.slug AS arrangement_slug,
             CASE WHEN length(a.text_lower) >= 3 AND (contains(a.text_lower, replace(p.slug, '-', ' '))
                    OR contains(replace(p.slug, '-', ' '), a.text_lower)) THEN 0.0
                  WHEN {DIST} <= 0.8 THEN round({DIST}, 3) END AS distance
      FROM v_atoms a, v_arrangements p
      WHERE a.category_slug IS NOT NULL AND a.status <> 'rejected' AND a.tag_version < 64)
    WHERE distance IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY atom_id ORDER BY distance, arrangement_slug) <= 4"""


@query("tag_arrangements", "H1 W2 X5", TAGS_SQL)
def tag_arrangements(t: Inputs):
    return arr.tag_rows(arr.tag_arrangements(t.v_atoms, t.v_arrangements, version=64))


@query("tag_dual_view", "H2", f"""
    SELECT atom_id AS id, string_agg(arrangement_slug, '|' ORDER BY distance, arrangement_slug) AS slugs
    FROM ({TAGS_SQL}) GROUP BY 1""")
def tag_dual_view(t: Inputs):
    rows = arr.tag_rows(arr.tag_arrangements(t.v_atoms, t.v_arrangements, version=64))
    return arr.tag_arrays(rows).select("id", F.array_join("arrangement_tags.slug", "|").alias("slugs"))


@query("reconcile_tags", "J19", f"""
    WITH tags AS ({TAGS_SQL}),
    a AS (SELECT atom_id, string_agg(arrangement_slug, '|' ORDER BY arrangement_slug) AS array_slugs FROM tags GROUP BY 1),
    b AS (SELECT atom_id, string_agg(arrangement_slug, '|' ORDER BY arrangement_slug) AS table_slugs FROM v_arrangement_atoms GROUP BY 1)
    SELECT coalesce(a.atom_id, b.atom_id) AS atom_id, array_slugs, table_slugs
    FROM a FULL JOIN b ON a.atom_id = b.atom_id WHERE array_slugs IS DISTINCT FROM table_slugs""")
def reconcile_tags(t: Inputs):
    tagged = arr.tag_arrangements(t.v_atoms, t.v_arrangements, version=64)
    out = arr.reconcile_tags(tagged, t.v_arrangement_atoms)
    return out.select(
        "atom_id", F.array_join("array_slugs", "|").alias("array_slugs"), F.array_join("table_slugs", "|").alias("table_slugs")
    )


def words(t: Inputs, df, *cols):
    """Categorical form of the numeric columns."""
    low_high = {
        "hardness": ("soft", "hard"), "temperature": ("cool", "warm"), "weight": ("light", "heavy"),
        "formality": ("organic", "structured"), "era_affinity": ("timeless", "modern"),
    }
    out = {
        d: F.when(F.col(d) < 0.35, lo).when(F.col(d) > 0.65, hi).otherwise("neutral")
        for d, (lo, hi) in low_high.items()
    }
    return df.withColumns(out)


WORD_SQL = {
    d: f"CASE WHEN {d} < 0.35 THEN '{lo}' WHEN {d} > 0.65 THEN '{hi}' ELSE 'neutral' END"
    for d, lo, hi in [
        ("hardness", "soft", "hard"), ("temperature", "cool", "warm"), ("weight", "light", "heavy"),
        ("formality", "organic", "structured"), ("era_affinity", "timeless", "modern"),
    ]
}


@query("numeric_harmonics", "H6 X10", "SELECT id, " + ", ".join(
    f"CASE {expr} WHEN '{lo}' THEN {lv} WHEN '{hi}' THEN {hv} ELSE 0.5 END::DOUBLE AS {d}"
    for (d, expr), (lo, lv, hi, hv) in zip(WORD_SQL.items(), [
        ("soft", 0.2, "hard", 0.8), ("cool", 0.2, "warm", 0.8), ("light", 0.2, "heavy", 0.8),
        ("organic", 0.2, "structured", 0.8), ("timeless", 0.25, "modern", 0.85)])
) + " FROM v_atoms")
def numeric_harmonics(t: Inputs):
    dims = arr.DIMENSIONS
    return arr.numeric_harmonics(words(t, t.v_atoms).select("id", *dims))


@query("legacy_similarity_tags", "H3", f"""
    WITH a AS (SELECT id, collection_slug, {', '.join(f'{e} AS {d}' for d, e in WORD_SQL.items())} FROM v_atoms),
    p AS (SELECT slug, {', '.join(f'{e} AS {d}' for d, e in WORD_SQL.items())} FROM v_arrangements),
    hits AS (SELECT a.id, p.slug FROM a, p WHERE (
      {' + '.join(f'CASE WHEN a.{d} = p.{d} THEN 1.0 ELSE 0.0 END' for d in WORD_SQL)}) / 5 >= 0.65)
    SELECT id, collection_slug AS tag FROM a UNION SELECT id, slug FROM hits""")
def legacy_similarity_tags(t: Inputs):
    atoms = words(t, t.v_atoms).withColumn("tags", F.array("collection_slug"))
    out = arr.legacy_similarity_tags(atoms, words(t, t.v_arrangements))
    return out.select("id", F.explode("tags").alias("tag"))


AXES = "(SELECT 'axis-half' AS axis_slug, 'hardness' AS harmonic_key UNION ALL SELECT 'axis-parity', 'register')"
POSITIONS = f"""
    positions AS (
      SELECT a.collection_slug AS board, m.axis_slug, a.id AS atom_id, a.text_lower, m.pole,
             CASE x.harmonic_key WHEN 'register' THEN a.register ELSE a.hardness END AS coord
      FROM v_atoms a JOIN v_memberships m ON m.atom_id = a.id JOIN {AXES} x ON x.axis_slug = m.axis_slug
      WHERE CASE x.harmonic_key WHEN 'register' THEN a.register ELSE a.hardness END IS NOT NULL)"""


def _positions(t: Inputs):
    axes = t.v_memberships.select("axis_slug").distinct().withColumn(
        "harmonic_key", F.when(F.col("axis_slug") == "axis-half", "hardness").otherwise("register")
    )
    board = t.v_atoms.select(F.col("collection_slug").alias("board"), F.col("id").alias("atom_id"))
    return arr.board_positions(board, t.v_memberships, axes, t.v_atoms)


@query("center_of_mass", "H4 H5", f"""
    WITH {POSITIONS}
    SELECT board, axis_slug, count(*) AS matched, round(round(avg(coord), 9), 4) AS mean, round(round(stddev_pop(coord), 9), 4) AS stdev,
           CASE WHEN count(*) < 5 THEN 'low' WHEN count(*) < 16 THEN 'medium' ELSE 'high' END AS confidence
    FROM positions GROUP BY 1, 2""")
def center_of_mass(t: Inputs):
    return arr.center_of_mass(_positions(t))


@query("driving_atoms", "W4", f"""
    WITH {POSITIONS}
    SELECT *, row_number() OVER (PARTITION BY board, axis_slug, pole
      ORDER BY CASE pole WHEN 'high' THEN -coord ELSE coord END, atom_id) AS place
    FROM positions QUALIFY place <= 5""")
def driving_atoms(t: Inputs):
    return arr.driving_atoms(_positions(t))
