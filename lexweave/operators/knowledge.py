"""Knowledge packages and combined knowledge queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.curation import running_index
from lexweave.operators.predicates import contexts_for_categories
from lexweave.operators.vectors import hydrate, is_chunk_id, knn

# Document title and category of each package type.
PACKAGE_ROUTES = {
    "compilation_outcome": ("Compilation Outcomes", "style.genre"),
    "character_dna": ("Character DNA Registry", "reference.character"),
    "aesthetic_research": ("Aesthetic Research", "style.genre"),
    "external_data": ("External Knowledge", None),
}

PACKAGE_SCHEMA = (
    "compilation struct<signal:string,extraction_model:string,generation_provider:string,generation_model:string,"
    "arrangement_slug:string,arrangement_score:double,style_anchors:array<string>,description:string,palette_mood:string,"
    "rendering_medium:string,render_mode:string,product_mode:string>, "
    "character struct<name:string,anchors:array<string>,flex:array<string>,description:string>, "
    "research struct<topic:string,content:string,arrangement_slug:string>"
)


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def package_content() -> Column:
    """Chunk text of a package by its type; empty lines leave."""
    c, p, r = F.col("compilation"), F.col("character"), F.col("research")
    generation = F.concat_ws("/", c["generation_provider"], c["generation_model"])
    head = F.format_string("Compilation: %s (%s @ %.3f)", c["signal"], c["arrangement_slug"], c["arrangement_score"])
    compilation = F.concat_ws(
        "\n",
        head,
        _line("Extraction: ", c["extraction_model"]),
        F.when(c["generation_provider"].isNotNull(), F.concat(F.lit("Generation: "), generation)),
        F.concat(F.lit("Anchors: "), F.array_join(c["style_anchors"], ", ")),
        F.when(c["description"] != "", c["description"]),
        _line("Palette: ", c["palette_mood"]),
        _line("Medium: ", c["rendering_medium"]),
        _line("Render mode: ", c["render_mode"]),
        _line("Product mode: ", c["product_mode"]),
    )
    character = F.concat_ws(
        "\n",
        F.concat(F.lit("Character: "), p["name"]),
        F.concat(F.lit("Anchors: "), F.array_join(p["anchors"], ", ")),
        F.concat(F.lit("Flex: "), F.array_join(p["flex"], ", ")),
        p["description"],
    )
    return (
        F.when(F.col("type") == "compilation_outcome", compilation)
        .when(F.col("type") == "character_dna", character)
        .otherwise(F.coalesce(r["content"], F.lit("")))
    )


def knowledge_packages(packages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, refused) of packages (package_id, type, source_app, compilation,
    character, research). A package needs the part its type names; chunks go on
    from the chunk count of their document."""
    title = category = F.lit(None).cast("string")
    for kind, (name, slug) in PACKAGE_ROUTES.items():
        title = F.when(F.col("type") == kind, name).otherwise(title)
        category = F.when(F.col("type") == kind, F.lit(slug)).otherwise(category)
    reason = (
        F.when(F.col("type").isNull() | F.col("source_app").isNull(), "type_and_source_required")
        .when(title.isNull(), "unknown_type")
        .when((F.col("type") == "compilation_outcome") & F.col("compilation").isNull(), "compilation_required")
        .when((F.col("type") == "character_dna") & F.col("character").isNull(), "character_required")
        .when((F.col("type") == "aesthetic_research") & F.col("research").isNull(), "research_required")
    )
    rows = packages.withColumn("reason", reason)
    slug = F.when(F.col("type") == "compilation_outcome", F.col("compilation.arrangement_slug")).when(
        F.col("type") == "aesthetic_research", F.col("research.arrangement_slug")
    )
    good = rows.filter(F.col("reason").isNull()).select(
        "package_id",
        title.alias("document"),
        package_content().alias("content"),
        category.alias("category_slug"),
        F.array_compact(F.array(slug)).alias("arrangement_slugs"),
    )
    have = documents.select(F.col("title").alias("document"), F.col("chunk_count").alias("_have"))
    chunks = (
        running_index(good, ["document"], "package_id", "_at")
        .join(have, "document", "left")
        .withColumn("chunk_index", F.col("_at") + F.coalesce("_have", F.lit(0)))
        .drop("_at", "_have")
    )
    return chunks, rows.filter(F.col("reason").isNotNull()).select("package_id", "reason")


IR_SCHEMA = (
    "meta struct<extraction_model:string>, style_anchors array<string>, visual_dna struct<description:string>, "
    "palette struct<mood:string>, rendering struct<medium:string>"
)


def outcome_packages(outcomes: DataFrame) -> DataFrame:
    """Outcome rows with a JSON detail as package rows, with defaults filled in."""
    j = outcomes.withColumn("j", F.from_json("ir", IR_SCHEMA))
    none = F.lit(None).cast("string")
    body = F.struct(
        F.col("signal").alias("signal"),
        F.coalesce("j.meta.extraction_model", F.lit("unknown")).alias("extraction_model"),
        F.coalesce("target_provider", "gen_provider").alias("generation_provider"),
        F.col("model").alias("generation_model"),
        F.coalesce("arrangement", F.lit("none")).alias("arrangement_slug"),
        F.lit(0.0).alias("arrangement_score"),
        F.coalesce("j.style_anchors", F.array().cast("array<string>")).alias("style_anchors"),
        F.coalesce("j.visual_dna.description", F.lit("")).alias("description"),
        F.col("j.palette.mood").alias("palette_mood"),
        F.col("j.rendering.medium").alias("rendering_medium"),
        F.col("render_mode").alias("render_mode"),
        none.alias("product_mode"),
    )
    return j.select(
        F.col("outcome_id").alias("package_id"),
        F.lit("compilation_outcome").alias("type"),
        F.lit("outcomes").alias("source_app"),
        body.alias("compilation"),
        F.lit(None).cast("struct<name:string,anchors:array<string>,flex:array<string>,description:string>").alias("character"),
        F.lit(None).cast("struct<topic:string,content:string,arrangement_slug:string>").alias("research"),
    )


def knowledge_query(
    queries: DataFrame,
    vectors: DataFrame,
    atoms: DataFrame,
    chunks: DataFrame,
    contexts: DataFrame,
    categories: DataFrame,
    *,
    context: str,
    k_terms: int = 50,
    k_chunks: int = 5,
    aesthetic: Column | None = None,
) -> dict[str, DataFrame]:
    """Guidance, chunk hits and term signals for a set of query vectors."""
    from lexweave.operators.aggregates import atom_signals

    terms = hydrate(knn(queries, vectors, k_terms, base_filter=~is_chunk_id("id")), atoms)
    near = knn(queries, vectors, k_chunks, base_filter=is_chunk_id("id"))
    return {
        "contexts": contexts_for_categories(contexts, categories, [context]),
        "chunks": near.join(chunks.withColumnRenamed("chunk_id", "neighbour_id"), "neighbour_id"),
        "signals": atom_signals(terms, aesthetic),
    }


def knowledge_answer(found: dict[str, DataFrame]) -> DataFrame:
    """(query_id, part, item, place, note): one table of what ``knowledge_query`` found.

    Contexts hold for all queries and have no query id; chunks are in the order of their
    scores; signals are the counts and the most frequent categories.
    """
    none = F.lit(None)
    contexts = found["contexts"].select(
        none.cast("string").alias("query_id"), F.lit("context").alias("part"), F.concat_ws("/", "category_slug", "context").alias("item"),
        none.cast("long").alias("place"), F.col("guidance").alias("note"),
    )
    chunks = found["chunks"].select("query_id", F.lit("chunk").alias("part"), F.col("neighbour_id").alias("item"), F.col("rank").cast("long").alias("place"), F.col("document_id").cast("string").alias("note"))
    signals = found["signals"].select("query_id", F.explode(F.array(
        F.struct(F.lit("aesthetic_matches").alias("item"), F.col("aesthetic_matches").cast("long").alias("place"), none.cast("string").alias("note")),
        F.struct(F.lit("texture_matches").alias("item"), F.col("texture_matches").cast("long").alias("place"), none.cast("string").alias("note")),
        F.struct(F.lit("categories").alias("item"), F.size("top_categories").cast("long").alias("place"), F.array_join("top_categories", "|").alias("note")),
    )).alias("s")).select("query_id", F.lit("signal").alias("part"), "s.item", "s.place", "s.note")
    return contexts.unionByName(chunks).unionByName(signals)
