"""Template filling for many requests at once.

A pick changes the scores of later slots of the same request, so slots are filled
rank by rank; each round is one set of joins for all requests, and its result is
written to the checkpoint folder. The driver only counts rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.maths import DIMENSIONS, profile_similarity
from lexweave.functions.sizing import broadcast_if_small
from lexweave.session import cut_lineage

# Fixed values of slot scoring.
TIER_WEIGHT = {1: 1.0, 2: 0.6, 3: 0.2}
WEIGHTS_WITH_PROFILE = {"exemplar": 0.30, "resonance": 0.25, "harmonic": 0.25, "tier": 0.15, "semantic": 0.05}
WEIGHTS_PLAIN = {"exemplar": 0.40, "resonance": 0.30, "harmonic": 0.00, "tier": 0.20, "semantic": 0.10}
PICK_FROM = 5
ALTERNATIVES = 3
RANDOM_FLOOR = 0.05
BOOST_CAP = 0.3
OPPOSED_STRENGTH = 0.7
OPPOSED_CONFIDENCE = 0.6
MIN_RESONANCE = 0.001
PROFILE = [*DIMENSIONS, "register"]


def slot_order(requests: DataFrame, slots: DataFrame, seeds: DataFrame, weights: DataFrame) -> DataFrame:
    """Fill order of the slots of each request: seeded, category weight, sort order."""
    rows = (
        requests.select("request_id", "template", "arrangement")
        .join(slots, "template")
        .join(seeds.select("request_id", "slot_name", F.col("atom_id").alias("seed_id")), ["request_id", "slot_name"], "left")
        .join(
            weights.select(F.col("slug").alias("arrangement"), F.col("category_slug").alias("category_filter"), F.col("weight").alias("slot_weight")),
            ["arrangement", "category_filter"],
            "left",
        )
    )
    order = Window.partitionBy("request_id").orderBy(
        F.when(F.col("seed_id").isNotNull(), 0).otherwise(1),
        -F.coalesce("slot_weight", F.lit(1.0)),
        "sort_order",
        "slot_name",
    )
    return rows.withColumn("rank", F.row_number().over(order))


def weighted_pick(cands: DataFrame, group: list[str], score: str, seed: int, top: int = PICK_FROM) -> DataFrame:
    """One of the best ``top`` of each group, with weight score squared plus a floor.

    The smallest -ln(u)/w wins; u is the start of an MD5 of group, row and seed, so a
    run can be repeated anywhere. ``place`` must hold the rank within the group.
    """
    drawn = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in (*group, "atom_id")], F.lit(str(seed))))
    u = (F.conv(F.left(drawn, F.lit(8)), 16, 10).cast("long") + 1) / F.lit(4_294_967_297.0)
    key = -F.log(u) / (F.col(score) * F.col(score) + RANDOM_FLOOR)
    best = cands.filter(F.col("place") <= top)
    rest = [c for c in cands.columns if c not in group]
    return best.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(key, F.col("atom_id"))).alias("w")).select(
        *group, *[F.col(f"w.{c}").alias(c) for c in rest]
    )


def _pair(a: str, b: str) -> list[Column]:
    """The two ends of a pair in text order, a null last."""
    ends = F.array_sort(F.array(a, b))
    return [ends[0].alias("one"), ends[1].alias("other")]


def from_both_ends(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (one, other) as (atom_id, chosen_id) of either end, where ``chosen`` has the chosen_id."""
    one, other = F.col("one"), F.col("other")
    ends = F.array_distinct(F.array(F.struct(one.alias("atom_id"), other.alias("chosen_id")), F.struct(other.alias("atom_id"), one.alias("chosen_id"))))
    rows = pairs.withColumn("e", F.explode(ends)).select("e.atom_id", "e.chosen_id", *[c for c in pairs.columns if c not in ("one", "other")])
    return rows.join(chosen, "chosen_id", "left_semi")


def pair_affinity(relations: DataFrame) -> DataFrame:
    """Strength times confidence of compositional pairs (one, other), the best per context; it holds from both ends."""
    rows = relations.filter(F.col("relation_type") == "compositional")
    return (
        rows.select(*_pair("source_atom_id", "target_atom_id"), F.coalesce("context", F.lit("")).alias("context"), (F.col("strength") * F.col("confidence")).alias("affinity"))
        .groupBy("one", "other", "context")
        .agg(F.max("affinity").alias("affinity"))
    )


def pair_resonance(edges: DataFrame) -> DataFrame:
    """Summed strength of the resonating edges of a pair (one, other); it holds from both ends, and an edge to itself has both."""
    rows = edges.filter(F.col("relationship_type").isin("resonates", "evokes"))
    twice = F.when(F.col("one").eqNullSafe(F.col("other")), 2).otherwise(1)
    return rows.select(*_pair("atom_a_id", "atom_b_id"), "strength").groupBy("one", "other").agg(
        F.sum("strength").alias("resonance")
    ).withColumn("resonance", F.col("resonance") * twice)


def opposed_contexts(relations: DataFrame) -> DataFrame:
    """(atom_id, context) of strong and confident oppositions."""
    rows = relations.filter(
        (F.col("relation_type") == "oppositional")
        & F.col("context").isNotNull()
        & (F.col("strength") >= OPPOSED_STRENGTH)
        & (F.col("confidence") >= OPPOSED_CONFIDENCE)
    )
    return rows.select(F.explode(F.array("source_atom_id", "target_atom_id")).alias("atom_id"), "context").distinct()


def candidate_pools(atoms: DataFrame) -> DataFrame:
    """All live terms per (category, modality). A term of both modalities is in either pool."""
    modality = F.when(F.col("modality") == "both", F.array(F.lit("visual"), F.lit("narrative"))).otherwise(F.array("modality"))
    return atoms.filter((F.col("status") != "rejected") & F.col("category_slug").isNotNull()).select(
        F.col("id").alias("atom_id"), "category_slug", F.explode(modality).alias("pool"), "tier", *PROFILE
    )


def pool_facts(pools: DataFrame, exemplars: DataFrame, opposed: DataFrame) -> DataFrame:
    """``pools`` with what is known of each term: ``shares`` by template and slot, ``against``, the contexts that oppose it.

    Both are joined once here, not to the candidates of every round.
    """
    shares = exemplars.groupBy("atom_id").agg(F.collect_list(F.struct("template", "slot_name", "exemplar_score")).alias("shares"))
    against = opposed.groupBy("atom_id").agg(F.collect_set("context").alias("against"))
    return pools.join(shares, "atom_id", "left").join(against, "atom_id", "left")


#: What a slot's scores depend on besides the request's own picks and intents.
LIST_KEY = ["template", "slot_name", "category_filter", "pool", "arrangement", "mode_context", "has_intent"]
#: Rows of a slot's list that are kept at first; twice as many whenever a request needs more.
LIST_ROWS = 64


def fixed_scores(keys: DataFrame, facts: DataFrame, profiles: DataFrame, *, by: list[str]) -> DataFrame:
    """``keys`` with candidate terms: ``fixed``, their score without picks and intents, and ``bad``, whether a context opposes them.

    ``keys`` have the columns LIST_KEY; they meet the pools on ``by``, which is the category
    and pool alone, or these and a term.
    """
    arr = profiles.select(F.col("slug").alias("arrangement"), *[F.col(d).alias(f"arr_{d}") for d in PROFILE], F.lit(True).alias("_profiled"))
    rows = keys.join(facts.withColumnRenamed("category_slug", "category_filter"), by).join(arr, "arrangement", "left")
    own = F.filter("shares", lambda s: (s["template"] == F.col("template")) & (s["slot_name"] == F.col("slot_name")))
    share = F.get(own, F.lit(0))["exemplar_score"]
    opposes = lambda context: F.coalesce(F.array_contains("against", F.col(context)), F.lit(False))
    profiled = F.coalesce("_profiled", F.lit(False))
    weight = {k: F.when(profiled, WEIGHTS_WITH_PROFILE[k]).otherwise(WEIGHTS_PLAIN[k]) for k in WEIGHTS_PLAIN}
    moved = F.when(F.col("has_intent"), 0.0).otherwise(weight["semantic"])
    tier = F.lit(0.2)
    for t, w in TIER_WEIGHT.items():
        tier = F.when(F.col("tier") == t, w).otherwise(tier)
    harmonic = F.when(
        profiled, profile_similarity({d: F.col(d) for d in PROFILE}, {d: F.col(f"arr_{d}") for d in PROFILE})
    ).otherwise(0.0)
    fixed = (weight["exemplar"] + moved) * F.coalesce(share, F.lit(0.0)) + weight["harmonic"] * harmonic + weight["tier"] * tier
    return rows.select(
        *keys.columns, *[c for c in ("atom_id",) if c not in keys.columns], fixed.alias("fixed"), (opposes("arrangement") | opposes("mode_context")).alias("bad"),
        weight["resonance"].alias("w_resonance"), F.when(F.col("has_intent"), weight["semantic"]).otherwise(0.0).alias("w_intent"),
    )


def ranked_lists(keys: DataFrame, facts: DataFrame, profiles: DataFrame, most: int) -> DataFrame:
    """(list, pos, chunk, atom_id, fixed, bad): the best ``most`` terms of every key, opposed ones last.

    Chunk c holds the places from 2**(c - 1) on, so whoever needs n rows reads less than 2 n.
    The literal limit cuts each list in the map tasks.
    """
    rows = fixed_scores(keys, facts, profiles, by=["category_filter", "pool"])
    order = Window.partitionBy("list").orderBy("bad", F.desc(F.round("fixed", 9)), "atom_id")
    placed = rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)
    return placed.select("list", "pos", F.length(F.bin("pos")).alias("chunk"), "atom_id", "fixed", "bad")


def own_terms(asked: DataFrame, chosen: DataFrame, intents: DataFrame, affinity: DataFrame, resonance: DataFrame) -> DataFrame:
    """(request_id, atom_id, resonance, boost, intent_score): the terms whose scores the request itself moves."""
    picks = cut_lineage(
        asked.select("request_id", "arrangement").distinct().join(chosen.select("request_id", F.col("atom_id").alias("chosen_id")), "request_id")
    )
    # few terms are chosen, so their ids go to the pairs
    ids = broadcast_if_small(picks.select("chosen_id").distinct())
    none = F.lit(None).cast("double")
    affinity, resonance = (from_both_ends(pairs, ids) for pairs in (affinity, resonance))
    res = picks.join(resonance, "chosen_id").select("request_id", "atom_id", "resonance", none.alias("boost"), none.alias("intent_score"))
    fits = (F.col("context") == "") | (F.col("context") == F.col("arrangement"))
    boost = picks.join(affinity, "chosen_id").filter(fits).select("request_id", "atom_id", none.alias("resonance"), (F.col("affinity") * BOOST_CAP).alias("boost"), none.alias("intent_score"))
    meant = intents.join(asked.select("request_id"), "request_id", "left_semi").select("request_id", "atom_id", none.alias("resonance"), none.alias("boost"), F.col("intent_score").cast("double").alias("intent_score"))
    return res.union(boost).union(meant).groupBy("request_id", "atom_id").agg(
        F.sum("resonance").alias("resonance"), F.max("boost").alias("boost"), F.max("intent_score").alias("intent_score")
    )


class SlotLists:
    """Scored candidates of one slot per request, from lists sorted once for all requests.

    Without picks and intents a term's score is the same for all requests of a key, so the
    best of them are the head of one list. A request adds the few terms that its own picks
    and intents move, and needs as many rows of the list as those and its picks can hide.
    """

    def __init__(self, plan: DataFrame, facts: DataFrame, profiles: DataFrame, list_rows: int = LIST_ROWS):
        self.sources = facts, profiles
        asked = plan.filter(F.col("seed_id").isNull() & F.col("guidance").isNull())
        self.keys = cut_lineage(asked.select(*LIST_KEY).distinct().withColumn("list", list_of()))
        self.most, self.lists = list_rows, None

    def head(self, need: int) -> DataFrame:
        if self.lists is None or need > self.most:
            while need > self.most:
                self.most *= 2
            self.lists = cut_lineage(ranked_lists(self.keys, *self.sources, self.most))
        return self.lists

    def score(self, asked: DataFrame, chosen: DataFrame, intents: DataFrame, affinity: DataFrame, resonance: DataFrame) -> DataFrame:
        """(request_id, slot_name, atom_id, score, place): the best PICK_FROM candidates of each request."""
        asked = asked.withColumn("list", list_of())
        picked = chosen.select("request_id", "atom_id")
        moved = own_terms(asked, chosen, intents, affinity, resonance).join(picked, ["request_id", "atom_id"], "left_anti")
        moved = asked.select("request_id", "list", *LIST_KEY).join(moved, "request_id")
        moved = cut_lineage(fixed_scores(moved, *self.sources, by=["category_filter", "pool", "atom_id"]))
        hidden = moved.select("request_id").union(picked.select("request_id")).groupBy("request_id").agg(F.count("*").alias("n"))
        needs = cut_lineage(
            asked.select("request_id", "slot_name", "list", "has_intent", "arrangement").join(hidden, "request_id", "left")
            .withColumn("need", F.coalesce("n", F.lit(0)).cast("int") + PICK_FROM)
        )
        most = needs.agg(F.max("need").alias("n")).first().n or PICK_FROM
        lists = self.head(most)
        chunks = F.sequence(F.lit(1), F.length(F.bin(F.col("need"))))
        plain = needs.withColumn("chunk", F.explode(chunks)).join(lists, ["list", "chunk"]).filter(F.col("pos") <= F.col("need"))
        plain = plain.join(picked, ["request_id", "atom_id"], "left_anti").join(moved.select("request_id", "atom_id"), ["request_id", "atom_id"], "left_anti")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        ceiling = moved.groupBy("request_id").agg(F.greatest(F.max(zero("resonance")), F.lit(MIN_RESONANCE)).alias("ceiling"))
        total = F.col("fixed") + F.col("w_resonance") * zero("resonance") / F.col("ceiling") + F.col("w_intent") * zero("intent_score") + zero("boost")
        rows = plain.select("request_id", "slot_name", "atom_id", F.round("fixed", 9).alias("score"), "bad").unionByName(
            moved.join(ceiling, "request_id").select("request_id", "slot_name", "atom_id", F.round(total, 9).alias("score"), "bad")
        )
        # opposed terms stay only where nothing else is left
        order = Window.partitionBy("request_id").orderBy("bad", F.desc("score"), "atom_id")
        best = rows.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= PICK_FROM)
        first = Window.partitionBy("request_id")
        best = best.withColumn("_bad", F.min("bad").over(first)).filter(F.col("bad") == F.col("_bad"))
        return best.select("request_id", "slot_name", "atom_id", "score", F.col("_row").alias("place"))


def list_of() -> Column:
    """The number of a slot's list; a null is a value like any other."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in LIST_KEY], F.lit("list"))


def fill_slots(
    requests: DataFrame,
    slots: DataFrame,
    seeds: DataFrame,
    atoms: DataFrame,
    exemplars: DataFrame,
    profiles: DataFrame,
    category_weights: DataFrame,
    contexts: DataFrame,
    edges: DataFrame,
    relations: DataFrame,
    intents: DataFrame,
    *,
    seed: int = 0,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """Fills (request_id, slot_name, atom_id, text, score, alternatives).

    ``requests``: request_id, template, arrangement, modality, render_mode,
    has_intent. There are as many rounds as the longest plan has slots.
    ``intents``: request_id, atom_id, intent_score (a reranker score where there is
    one, else the vector score). A replace-mode context fills its slot with the
    guidance text; a required slot without candidates is filled with nothing. Terms are
    scored once per kind of slot (``SlotLists``), of whose lists ``list_rows`` rows are held
    at first; no result depends on that number.
    """
    ordered = slot_order(requests.drop("modality", "render_mode", "has_intent"), slots, seeds, category_weights)
    mode = contexts.filter((F.col("context_mode") == "replace") & (F.coalesce("guidance", F.lit("")) != "")).select(
        F.col("context").alias("context_key"), F.col("category_slug").alias("category_filter"), "guidance"
    )
    keys = profiles.select(F.col("slug").alias("arrangement"), "context_key")
    plan = cut_lineage(
        ordered.join(keys, "arrangement", "left").join(mode, ["context_key", "category_filter"], "left").join(
            requests.select(
                "request_id",
                F.col("modality").alias("pool"),
                F.concat(F.lit("render_mode="), "render_mode").alias("mode_context"),
                "has_intent",
            ),
            "request_id",
        )
    )
    # one row per (template, slot, term); the largest of a slot is a row per slot, so no slot lies in one task
    shown = cut_lineage(exemplars.groupBy("template", "slot_name", "atom_id").agg(F.max("frequency").alias("frequency")))
    best = broadcast_if_small(shown.groupBy("template", "slot_name").agg(F.max("frequency").alias("_max")))
    shares = shown.join(best, ["template", "slot_name"]).select("template", "slot_name", "atom_id", (F.col("frequency") / F.col("_max")).alias("exemplar_score"))
    # every round reads these, so each is worked out once
    facts = cut_lineage(pool_facts(candidate_pools(atoms), shares, opposed_contexts(relations)))
    intents, profiles, affinity, resonance = (cut_lineage(df) for df in (intents, profiles, pair_affinity(relations), pair_resonance(edges)))
    lists = SlotLists(plan, facts, profiles, list_rows)
    none = F.lit(None).cast("array<struct<atom_id:string,score:double>>")
    filled = None
    schema = "request_id string, slot_name string, atom_id string, guidance string, score double, alternatives array<struct<atom_id:string,score:double>>"
    chosen = requests.sparkSession.createDataFrame([], schema)
    rounds = plan.agg(F.max("rank").alias("n")).first().n or 0
    for rank in range(1, rounds + 1):
        now = plan.filter(F.col("rank") == rank)
        seeded = now.filter(F.col("seed_id").isNotNull()).select(
            F.col("request_id").cast("string").alias("request_id"), "slot_name", F.col("seed_id").alias("atom_id"), F.lit(None).cast("string").alias("guidance"),
            F.lit(1.0).alias("score"), none.alias("alternatives"),
        )
        replaced = now.filter(F.col("seed_id").isNull() & F.col("guidance").isNotNull()).select(
            F.col("request_id").cast("string").alias("request_id"), "slot_name", F.lit(None).cast("string").alias("atom_id"), "guidance", F.lit(1.0).alias("score"),
            none.alias("alternatives"),
        )
        asked = now.filter(F.col("seed_id").isNull() & F.col("guidance").isNull())
        picked = chosen.filter(F.col("atom_id").isNotNull())
        # at most PICK_FROM rows per request, read three times below
        cands = cut_lineage(lists.score(asked, picked, intents, affinity, resonance))
        winners = weighted_pick(cands, ["request_id", "slot_name"], "score", seed)
        others = (
            cands.join(winners.select("request_id", F.col("atom_id").alias("_w")), "request_id")
            .filter(F.col("atom_id") != F.col("_w"))
            .groupBy("request_id")
            .agg(F.array_sort(F.collect_list(F.struct("place", "atom_id", "score"))).alias("_o"))
            .select(
                "request_id",
                F.transform(F.slice("_o", 1, ALTERNATIVES), lambda o: F.struct(o["atom_id"].alias("atom_id"), F.round(o["score"], 3).alias("score"))).alias("alternatives"),
            )
        )
        scored = winners.join(others, "request_id", "left").select(
            F.col("request_id").cast("string").alias("request_id"), "slot_name", "atom_id", F.lit(None).cast("string").alias("guidance"),
            F.round("score", 3).alias("score"), "alternatives",
        )
        empty = asked.filter("required").join(winners.select("request_id"), "request_id", "left_anti").select(
            F.col("request_id").cast("string").alias("request_id"), "slot_name", F.lit(None).cast("string").alias("atom_id"), F.lit(None).cast("string").alias("guidance"),
            F.lit(0.0).alias("score"), none.alias("alternatives"),
        )
        filled = cut_lineage(chosen.unionByName(seeded).unionByName(replaced).unionByName(scored).unionByName(empty))
        chosen = filled
    filled = chosen if filled is None else filled
    text = atoms.select(F.col("id").alias("atom_id"), F.col("text").alias("_text"))
    order = plan.select(F.col("request_id").cast("string").alias("request_id"), "slot_name", "sort_order")
    return filled.join(text, "atom_id", "left").join(order, ["request_id", "slot_name"]).select(
        "request_id",
        "slot_name",
        "sort_order",
        "atom_id",
        F.coalesce("guidance", "_text", F.lit("")).alias("text"),
        "score",
        "alternatives",
    )


def tidy_prompt(text: Column) -> Column:
    """Empty placeholders and doubled commas out."""
    out = F.regexp_replace(text, r"\{[a-z_]+\}", "")
    for pattern, by in [(r",\s*,", ","), (r"\(\s*,", "("), (r",\s*\)", ")"), (r"^[,\s]+|[,\s]+$", "")]:
        out = F.regexp_replace(out, pattern, by)
    return out


def assemble_prompts(fills: DataFrame, requests: DataFrame, templates: DataFrame) -> DataFrame:
    """(request_id, prompt): placeholders replaced once each, or texts joined in slot
    order for a template without text."""
    usable = fills.filter(F.col("text") != "").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("sort_order", "slot_name", "text"))).alias("fills")
    )
    rows = requests.select(F.col("request_id").cast("string").alias("request_id"), "template").join(templates, "template").join(usable, "request_id", "left")
    fills_or_none = F.coalesce("fills", F.array().cast("array<struct<sort_order:int,slot_name:string,text:string>>"))

    def put(acc: Column, f: Column) -> Column:
        mark = F.concat(F.lit("{"), f["slot_name"], F.lit("}"))
        at = F.instr(acc, mark)
        head = F.left(acc, at - 1)
        tail = F.substring(acc, at + F.length(mark), F.length(acc))
        return F.when(at > 0, F.concat(head, f["text"], tail)).otherwise(acc)

    filled = F.aggregate(fills_or_none, F.col("template_text"), put)
    joined = F.array_join(F.transform(fills_or_none, lambda f: f["text"]), ", ")
    return rows.select(
        "request_id", F.when(F.col("template_text").isNull(), joined).otherwise(tidy_prompt(filled)).alias("prompt")
    )


def fill_report(fills: DataFrame) -> DataFrame:
    """Slots filled and mean score of the slots that have one."""
    scored = F.when(F.col("score") > 0, F.col("score"))
    return fills.groupBy("request_id").agg(
        F.count("*").alias("slots"), F.coalesce(F.round(F.round(F.avg(scored), 9), 3), F.lit(0.0)).alias("total_score")
    )


def fill_oppositions(fills: DataFrame, edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """``opposes`` edges between two picks of the same request, with texts.

    Picks of a request are paired first (a template has few slots), so a hub term
    does not multiply by its edges.
    """
    picks = fills.filter(F.col("atom_id").isNotNull()).select("request_id", "atom_id").distinct()
    pairs = (
        picks.withColumnRenamed("atom_id", "atom_a_id")
        .join(picks.withColumnRenamed("atom_id", "atom_b_id"), "request_id")
        .filter(F.col("atom_a_id") < F.col("atom_b_id"))
    )
    against = edges.filter(F.col("relationship_type") == "opposes").select(
        F.least("atom_a_id", "atom_b_id").alias("atom_a_id"), F.greatest("atom_a_id", "atom_b_id").alias("atom_b_id")
    ).distinct()
    text = atoms.select("id", "text")
    return (
        pairs.join(against, ["atom_a_id", "atom_b_id"], "left_semi")
        .join(text.select(F.col("id").alias("atom_a_id"), F.col("text").alias("text_a")), "atom_a_id")
        .join(text.select(F.col("id").alias("atom_b_id"), F.col("text").alias("text_b")), "atom_b_id")
        .select("request_id", "atom_a_id", "atom_b_id", "text_a", "text_b")
    )
