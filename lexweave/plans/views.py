"""Derived views that bind the driver's tables to the graph model.

Each view is one SELECT that Spark and DuckDB read alike; ``{name}`` is a table
or another view. They only rename and rescale columns of whole tables.
"""

VIEWS: dict[str, str | tuple[str, str]] = {
    # terms: one per part
    "v_atoms": """
        SELECT 'a' || p_partkey AS id, p_name AS text, lower(trim(p_name)) AS text_lower,
               lower(replace(p_brand, '#', '-')) AS collection_slug,
               CASE WHEN p_size <= 2 THEN NULL
                    WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size.' || lower(p_type)
                    ELSE 'line.' || lower(p_type) END AS category_slug,
               CASE WHEN p_size <= 10 THEN 'provisional' WHEN p_size > 46 THEN 'rejected'
                    ELSE 'confirmed' END AS status,
               CASE WHEN p_brand < 'Brand#15' THEN 'manual' WHEN p_brand < 'Brand#20' THEN 'seed'
                    ELSE 'ai' END AS source,
               'app-' || lower(p_type) AS source_app,
               CASE WHEN p_size > 40 THEN 'utility' ELSE 'observation' END AS observation,
               round(CAST(p_size AS double) / 50, 4) AS confidence,
               p_size % 7 AS encounter_count,
               round(CAST(p_size AS double) / 50, 4) AS hardness,
               round((p_retailprice - floor(p_retailprice / 100) * 100) / 100, 4) AS temperature,
               round(length(p_name) / 16.0, 4) AS weight,
               round(CAST(51 - p_size AS double) / 50, 4) AS formality,
               CASE WHEN p_type = 'PROMO' THEN 0.9 WHEN p_type = 'ECONOMY' THEN 0.1
                    ELSE 0.5 END AS era_affinity,
               CASE WHEN p_size > 40 THEN NULL ELSE round(CAST(p_size AS double) / 40, 4) END
                    AS register,
               1 + p_size % 3 AS tier, p_size % 40 AS tag_version,
               CASE WHEN p_size < 20 THEN 'pending' WHEN p_size < 24 THEN 'failed'
                    ELSE 'complete' END AS embedding_status,
               CASE WHEN p_size > 30 THEN 'visual' ELSE 'both' END AS modality,
               CAST(date '2024-01-01' + p_size AS timestamp) AS created_at,
               CAST(date '2024-01-01' + p_size + p_size % 3 AS timestamp) AS updated_at,
               CASE WHEN p_size % 4 = 0 THEN NULL
                    ELSE CAST(date '2024-02-01' + p_size AS timestamp) END AS last_enqueued_at
        FROM {part}""",
    "v_vectors": """
        SELECT 'a' || vec_id AS id, embedding AS vec, 'cat.' || label AS category_slug, label
        FROM {embeddings}""",
    # edges: part and supplier of a line item
    "v_edge_events": """
        SELECT least('a' || l_partkey, 'a' || l_suppkey) AS atom_a_id,
               greatest('a' || l_partkey, 'a' || l_suppkey) AS atom_b_id,
               CASE l_returnflag WHEN 'A' THEN 'resonates' WHEN 'N' THEN 'evokes'
                    ELSE 'opposes' END AS relationship_type,
               round(l_discount * 10, 2) AS strength,
               CASE l_linestatus WHEN 'F' THEN 'semantic' ELSE 'harmonic' END AS provenance,
               CASE WHEN l_linenumber = 7 THEN 'studio' ELSE '' END AS arrangement_scope,
               l_shipdate AS last_reinforced_at
        FROM {lineitem} WHERE l_partkey <> l_suppkey""",
    "v_edges": """
        SELECT atom_a_id, atom_b_id, relationship_type, arrangement_scope,
               max(strength) AS strength, min(provenance) AS provenance,
               max(last_reinforced_at) AS last_reinforced_at
        FROM {v_edge_events}
        GROUP BY atom_a_id, atom_b_id, relationship_type, arrangement_scope""",
    "v_relations": """
        SELECT 'a' || l_partkey AS source_atom_id, 'a' || l_suppkey AS target_atom_id,
               CASE l_returnflag WHEN 'A' THEN 'compositional' WHEN 'R' THEN 'oppositional'
                    ELSE 'modifier' END AS relation_type,
               CASE l_linenumber WHEN 1 THEN NULL ELSE 'ctx-' || l_linenumber END AS context,
               round(max(1 - l_discount * 5), 2) AS strength,
               round(max(1 - l_tax * 5), 2) AS confidence
        FROM {lineitem}
        GROUP BY l_partkey, l_suppkey, l_returnflag, l_linenumber""",
    # tags: the label of a vector, and its price band
    "v_atom_tags": """
        SELECT 'a' || vec_id AS atom_id, 'tag-' || label AS tag_id FROM {embeddings}
        UNION ALL
        SELECT 'a' || vec_id AS atom_id, 'half-' || (label % 2) AS tag_id FROM {embeddings}""",
    "v_memberships": """
        SELECT 'a' || vec_id AS atom_id, 'axis-half' AS axis_slug,
               CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS pole FROM {embeddings}
        UNION ALL
        SELECT 'a' || vec_id AS atom_id, 'axis-parity' AS axis_slug,
               CASE WHEN label % 2 = 0 THEN 'low' ELSE 'high' END AS pole FROM {embeddings}""",
    # profiles: one per distinct part name
    "v_arrangements": """
        SELECT lower(replace(p_name, ' ', '-')) AS slug, p_name AS name,
               round(avg(CAST(p_size AS double)) / 50, 4) AS hardness,
               round(CAST(min(p_size) AS double) / 50, 4) AS temperature,
               round(length(p_name) / 16.0, 4) AS weight,
               round(CAST(max(p_size) AS double) / 50, 4) AS formality,
               round(CAST(count(DISTINCT p_brand) AS double) / 25, 4) AS era_affinity,
               CASE WHEN min(p_name) < 'm' THEN NULL ELSE 0.25 END AS register
        FROM {part} GROUP BY p_name""",
    "v_arrangement_weights": """
        SELECT lower(replace(p_name, ' ', '-')) AS slug,
               CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size.' || lower(p_type)
                    ELSE 'line.' || lower(p_type) END AS category_slug,
               round(avg(CAST(p_size AS double)) / 50, 4) AS weight
        FROM {part} GROUP BY p_name, p_type""",
    "v_arrangement_atoms": """
        SELECT lower(replace(p_name, ' ', '-')) AS arrangement_slug, 'a' || p_partkey AS atom_id,
               round(CAST(p_size AS double) / 50, 4) AS distance
        FROM {part}""",
    "v_categories": """
        SELECT DISTINCT
               CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size.' || lower(p_type)
                    ELSE 'line.' || lower(p_type) END AS slug,
               CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size'
                    ELSE 'line' END AS parent,
               p_type AS label
        FROM {part} WHERE p_type <> 'LARGE'
        UNION ALL
        SELECT 'region.' || lower(r_name) AS slug, 'region' AS parent, r_name AS label
        FROM {region}""",
    "v_category_contexts": """
        SELECT c.slug AS category_slug, x.context AS context,
               'Describe ' || c.label || ' for ' || x.context AS guidance,
               CASE WHEN x.context = 'default' THEN 'enrich' ELSE 'replace' END AS context_mode
        FROM {v_categories} c JOIN (
            SELECT DISTINCT o_orderstatus AS context FROM {orders}
            UNION ALL SELECT DISTINCT 'default' AS context FROM {orders}) x
          ON x.context = 'default' OR c.parent = 'size'""",
    "v_category_relations": """
        SELECT DISTINCT 'line.' || lower(p.p_type) AS source_slug,
               'region.' || lower(r.r_name) AS target_slug,
               CASE l.l_returnflag WHEN 'R' THEN 'excludes' ELSE 'pairs_with' END AS relation
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
        JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
        JOIN {nation} n ON s.s_nationkey = n.n_nationkey
        JOIN {region} r ON n.n_regionkey = r.r_regionkey""""",
    "v_collections": """
        SELECT lower(replace(p_brand, '#', '-')) AS slug,
               'type-' || lower(max(p_type)) AS parent_slug FROM {part} GROUP BY p_brand
        UNION ALL
        SELECT DISTINCT 'type-' || lower(p_type) AS slug, CAST(NULL AS varchar(9)) AS parent_slug
        FROM {part}""",
    # signals, sightings and runs: the event stream
    "v_signals": """
        SELECT event_id AS signal_id, event_type AS topic, 'sub-' || user_id AS subreddit,
               CASE WHEN value < 5 THEN 'negative' WHEN value < 20 THEN 'neutral'
                    ELSE 'positive' END AS sentiment,
               round(value / 500, 4) AS intensity, 'pain ' || (user_id % 40) AS pain_point,
               'want ' || (user_id % 12) AS feature_request, CAST(ts AS date) AS scan_date
        FROM {events}""",
    "v_runs": """
        SELECT event_id AS run_id, 'phase_' || event_type AS phase, ts AS completed_at,
               user_id AS items_processed, CASE WHEN value > 40 THEN 1 ELSE 0 END AS items_failed
        FROM {events}""",
    # documents as chunks of their source
    "v_chunks": """
        SELECT 'doc_chunk_' || doc_id AS chunk_id, source AS document_id, doc_id AS chunk_index,
               text AS content, lang, n_chars FROM {documents}""",
}
