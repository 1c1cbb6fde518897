"""List files to tags, memberships and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import let

MAX_FILE_TERMS = 100
CO_STRENGTH = 0.5
MOVEMENT_STRENGTH = 0.7

# File names of movements that no pattern finds.
NON_ISM_MOVEMENTS = [
    "baroque", "rococo", "art_nouveau", "art_deco", "bauhaus",
    "pop-art", "op-art", "renaissance", "realism", "art_brut",
    "classicism", "neo-classicism", "romanticism",
]

# File name patterns in order; the first match counts.
# (pattern, kind, tags, axis, pole)
FILE_RULES = [
    (r"^body-heavy$", "axis", [], "body-mass", "high"),
    (r"^body-light$", "axis", [], "body-mass", "low"),
    (r"^body-fit$", "axis", [], "body-condition", "high"),
    (r"^body-poor$", "axis", [], "body-condition", "low"),
    (r"^body-tall$", "axis", [], "body-height", "high"),
    (r"^body-short$", "axis", [], "body-height", "low"),
    (r"^body-shape$", "tag", ["attribute-type:body-shape"], None, None),
    (r"_combinations\b", "skip", [], None, None),
    (r"^noun", "skip", [], None, None),
    (r"^verb", "skip", [], None, None),
    (r"^e621-", "skip", [], None, None),
    (r"^artist[-_]", "skip", [], None, None),
    (r"^artist$", "skip", [], None, None),
    (r"^artist-csv$", "skip", [], None, None),
    (r"^material_(.+)$", "material", [], None, None),
    (r"^clothing_male_", "tag", ["gender:male"], None, None),
    (r"^clothing_female_", "tag", ["gender:female"], None, None),
    (r"^clothing_traditional$", "tag", ["formality:traditional"], None, None),
    (r"^clothing_asia_", "tag", ["cultural-origin:east-asian"], None, None),
    (r"^attire_jewelry_and_accessories_head_and_face$", "tag", ["body-region:head", "attribute-type:jewelry"], None, None),
    (r"^attire_jewelry_and_accessories_limbs$", "tag", ["body-region:limbs", "attribute-type:jewelry"], None, None),
    (r"^attire_jewelry_and_accessories_neck_and_shoulders$", "tag", ["body-region:neck", "attribute-type:jewelry"], None, None),
    (r"^attire_jewelry_and_accessories_torso_and_misc$", "tag", ["body-region:torso", "attribute-type:jewelry"], None, None),
    (r"^attire_headwear$", "tag", ["body-region:head"], None, None),
    (r"^attire_shirts_", "tag", ["body-region:upper-body"], None, None),
    (r"^attire_pants_", "tag", ["body-region:lower-body"], None, None),
    (r"^attire_legs_and_feet$", "tag", ["body-region:legs", "body-region:feet"], None, None),
    (r"^attire_shoes_", "tag", ["body-region:feet"], None, None),
    (r"^attire_swimsuits_", "tag", ["formality:swimwear", "attribute-type:garment"], None, None),
    (r"^attire_uniforms_", "tag", ["formality:costume", "attribute-type:garment"], None, None),
    (r"^attire_traditional_", "tag", ["formality:traditional"], None, None),
    (r"^attire_styles_.*_patterns$", "tag", ["attribute-type:pattern"], None, None),
    (r"^attire_styles_.*_prints$", "tag", ["attribute-type:print"], None, None),
    (r"^attire_other$", "tag", ["attribute-type:trim"], None, None),
    (r"ism$", "movement", [], None, None),
    (r"_painters$", "movement", [], None, None),
    (r"_painters_", "movement", [], None, None),
]


RULE = "array<struct<pattern:string,kind:string,tags:array<string>,axis:string,pole:string>>"


def rule_table(rules: list[tuple], movements: list[str]) -> Column:
    """The rules as one constant array; named movements come first."""
    lit = lambda v: F.lit(v).cast("string")
    first = [("^(" + "|".join(movements) + ")$", "movement", [], None, None)] if movements else []
    rows = [
        F.struct(
            lit("(?i)" + pattern).alias("pattern"),
            lit(kind).alias("kind"),
            F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
            lit(axis).alias("axis"),
            lit(pole).alias("pole"),
        )
        for pattern, kind, tags, axis, pole in first + rules
    ]
    return F.array(*rows).cast(RULE)


def classify_files(files: DataFrame, rules: list[tuple] = FILE_RULES, movements: list[str] = NON_ISM_MOVEMENTS) -> DataFrame:
    """Kind, tags, axis, pole and movement of each file name (file)."""
    base = F.lower(F.regexp_replace("file", r"\.txt$", ""))
    first = lambda b: F.try_element_at(F.filter(rule_table(rules, movements), lambda r: F.rlike(b, r["pattern"])), F.lit(1))

    def described(b: Column) -> Column:
        return let(first(b), lambda r: labelled(b, r))

    def labelled(b: Column, r: Column) -> Column:
        kind = r["kind"]
        slug = F.concat(F.lit("movement:"), F.replace(b, F.lit("_"), F.lit("-")))
        material = F.concat(F.lit("material-class:"), F.regexp_extract(b, "^material_(.+)$", 1))
        movement = kind == "movement"
        return F.struct(
            F.when(kind.isin("tag", "material", "skip"), "content").otherwise(F.coalesce(kind, F.lit("unmatched"))).alias("kind"),
            F.when(movement, F.array(slug))
            .when(kind == "material", F.array(material))
            .otherwise(F.coalesce(r["tags"], F.array().cast("array<string>")))
            .alias("tags"),
            r["axis"].alias("axis"),
            r["pole"].alias("pole"),
            F.when(movement, slug).alias("movement_slug"),
            F.when(movement, F.trim(F.translate(b, "_-", "  "))).alias("movement_name"),
            F.coalesce(kind == "skip", F.lit(False)).alias("skip_co_membership"),
        )

    return files.select("file", let(base, described).alias("d")).select("file", "d.*")


def edge_id(source: str) -> Column:
    return F.concat_ws(":", F.lit("wbs"), F.lit(source), "atom_a_id", "atom_b_id")


def oversized_files(file_terms: DataFrame, max_size: int = MAX_FILE_TERMS) -> DataFrame:
    """(file, terms) of the files with more than ``max_size`` different terms."""
    sizes = file_terms.groupBy("file").agg(F.count_distinct("atom_id").alias("terms"))
    return sizes.filter(F.col("terms") > max_size)


def co_membership_edges(file_terms: DataFrame, files: DataFrame, max_size: int = MAX_FILE_TERMS) -> DataFrame:
    """Edges between the terms of each file that may pair, each pair once.

    A file over ``max_size`` terms makes no pairs, so the pairs of one file are
    bounded and the join stays even; ``oversized_files`` names those files.
    """
    members = file_terms.select("file", "atom_id").distinct()
    sizes = members.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_size))
    allowed = sizes.join(files.filter("skip_co_membership").select("file"), "file", "left_anti").select("file")
    small = members.join(allowed, "file", "left_semi")
    other = small.withColumnRenamed("atom_id", "atom_b_id")
    pairs = small.withColumnRenamed("atom_id", "atom_a_id").join(other, "file").filter(F.col("atom_a_id") < F.col("atom_b_id"))
    return pairs.select("atom_a_id", "atom_b_id").distinct().select(
        "atom_a_id", "atom_b_id", F.lit(CO_STRENGTH).alias("strength"), edge_id("wildcard-co-membership").alias("id")
    )


def movement_edges(file_terms: DataFrame, files: DataFrame, atoms: DataFrame) -> DataFrame:
    """Edges from the members of a movement file to the term of that very name."""
    movements = files.filter(F.col("movement_name").isNotNull()).select("file", F.col("movement_name").alias("text_lower"))
    named = atoms.groupBy("text_lower").agg(F.min("id").alias("movement_id"))
    target = movements.join(named, "text_lower").select("file", "movement_id")
    pairs = file_terms.join(target, "file").filter(F.col("atom_id") != F.col("movement_id"))
    ends = pairs.select(
        F.least("atom_id", "movement_id").alias("atom_a_id"), F.greatest("atom_id", "movement_id").alias("atom_b_id")
    ).distinct()
    return ends.select("atom_a_id", "atom_b_id", F.lit(MOVEMENT_STRENGTH).alias("strength"), edge_id("movement-membership").alias("id"))


def bootstrap_payloads(
    file_terms: DataFrame, files: DataFrame, entry_tags: DataFrame, atoms: DataFrame, known_tags: DataFrame
) -> dict[str, DataFrame]:
    """What resolved list files add: tags, term tags, memberships, both edge kinds,
    and how many term tags name a tag that does not exist yet."""
    by_file = file_terms.select("file", "atom_id").join(files, "file")
    from_files = by_file.select("atom_id", F.explode("tags").alias("slug"))
    atom_tags = from_files.unionByName(entry_tags.select("atom_id", F.col("tag").alias("slug"))).distinct()
    tags = atom_tags.select("slug").distinct().select("slug", F.split_part("slug", F.lit(":"), F.lit(1)).alias("category"))
    memberships = by_file.filter(F.col("axis").isNotNull()).select("atom_id", F.col("axis").alias("axis_slug"), "pole").distinct()
    missing = atom_tags.join(known_tags.select("slug"), "slug", "left_anti").agg(F.count("*").alias("missing_tags"))
    return {
        "tags": tags,
        "atom_tags": atom_tags,
        "memberships": memberships,
        "co_membership": co_membership_edges(file_terms, files),
        "movement": movement_edges(file_terms, files, atoms),
        "missing": missing,
    }


def payload_counts(payloads: dict[str, DataFrame]) -> DataFrame:
    """Rows of each payload, for a dry run."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("payload"), "n")
        for name, df in payloads.items()
        if name != "missing"
    ]
    lost = payloads["missing"].select(F.lit("missing_tags").alias("payload"), F.col("missing_tags").alias("n"))
    return reduce(DataFrame.unionByName, [*parts, lost])
