"""Question routing, the bounded corrective loop, judges that fail open, and fan-out over sub-questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FOREIGN, keep_script, own_script, question_type
from ..settings import DEFAULTS, Settings

#: Overrides by question type: (type, neighbor_window, generate_top_n, context_order, prompt_variant).
STRATEGIES = (("aggregation", 1, 3, None, None), ("enumeration", 1, None, None, None))


def routed(questions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """questions with type, neighbor_window, generate_top_n, context_order, prompt_variant and use_team."""
    out = questions.withColumn("type", question_type(F.col("question")))

    def pick(at: int, default: object) -> Column:
        chosen = [F.when(F.col("type") == t, F.lit(said[at])) for t, *said in STRATEGIES if settings.type_routing and said[at] is not None]
        return F.coalesce(*chosen, F.lit(default))

    names = ("neighbor_window", "generate_top_n", "context_order", "prompt_variant")
    out = out.withColumns({name: pick(at, getattr(settings, name)) for at, name in enumerate(names)})
    return out.withColumn("use_team", (F.col("type") == "comparison") & F.lit(settings.team_routing))


def verdict(judged: Column) -> Column:
    """yes: sufficient; no: insufficient; anything else can't be parsed and counts as sufficient."""
    word = F.lower(F.trim(judged))
    return F.when(word.startswith("no"), "insufficient").otherwise("sufficient")


def verified(answers: DataFrame, judge: Callable[[DataFrame], DataFrame] | None, settings: Settings = DEFAULTS) -> DataFrame:
    """answers with grounded (null: not judged, or the verdict can't be parsed) and unsupported_claim. The answer never changes.

    judge adds `raw`: a JSON object with grounded and unsupported_claim.
    """
    if judge is None or not settings.verify_grounding:
        return answers.withColumns({"grounded": F.lit(None).cast("boolean"), "unsupported_claim": F.lit(None).cast("string")})
    said = judge(answers)
    found = F.from_json("raw", "grounded boolean, unsupported_claim string")
    claim = F.when(found["grounded"].isNotNull() & (F.trim(found["unsupported_claim"]) != ""), found["unsupported_claim"])
    return said.select(*[F.col(c) for c in answers.columns], found["grounded"].alias("grounded"), claim.alias("unsupported_claim"))


def repaired(answers: DataFrame, repair: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answers without sentences of a foreign script. Where too little would be left, repair adds `repaired`; a repair that is
    foreign too is cut likewise, and if nothing is left of it the first answer stays."""
    said = F.col("answer")
    lost = F.coalesce(said.rlike(FOREIGN) & own_script(said).isNull(), F.lit(False))
    kept = answers.where(~lost).withColumn("answer", keep_script(said))
    new = F.when(~F.col("repaired").rlike(FOREIGN), F.trim("repaired")).otherwise(own_script(F.col("repaired")))
    return kept.unionByName(repair(answers.where(lost)).withColumn("answer", F.coalesce(new, said)).select(*answers.columns))


def after_retrieve(rewrites: Column, most: int = 1) -> Column:
    """Grading is skipped where its answer couldn't change the way."""
    return F.when(rewrites >= most, "generate").otherwise("grade")


def after_grade(grade: Column, rewrites: Column, most: int = 1) -> Column:
    return F.when((grade == "sufficient") | (rewrites >= most), "generate").otherwise("rewrite")


def after_rewrite(failed: Column) -> Column:
    return F.when(failed, "generate").otherwise("retrieve")


def corrective_loop(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], grade: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], settings: Settings = DEFAULTS, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Unrolled: at most max_rewrites + 1 retrievals. Functions take and return question rows (query_id, question, query, rewrites, ...).

    retrieve adds `documents`; grade adds `judged` (text); rewrite adds `new_query` (null if it failed). Only rows that need
    a step are given to its function, so an expensive judge never sees the rest; settle may write a
    table between steps, as each step's rows are read by two branches.
    """
    waiting = questions.withColumns({"query": F.col("question"), "rewrites": F.lit(0)})
    done: DataFrame | None = None
    columns = None
    for _ in range(settings.max_rewrites + 1):
        found = settle(retrieve(waiting))
        columns = columns or found.columns
        to_grade = found.where(after_retrieve(F.col("rewrites"), settings.max_rewrites) == "grade")
        straight = found.where(after_retrieve(F.col("rewrites"), settings.max_rewrites) == "generate")
        graded = settle(grade(to_grade).withColumn("grade", verdict(F.col("judged"))))
        step = after_grade(F.col("grade"), F.col("rewrites"), settings.max_rewrites)
        rewritten = settle(rewrite(graded.where(step == "rewrite")).withColumn("rewrites", F.col("rewrites") + 1))
        failed = F.col("new_query").isNull()
        finished = [straight.select(*columns), graded.where(step == "generate").select(*columns), rewritten.where(failed).select(*columns)]
        for part in finished:
            done = part if done is None else done.unionByName(part)
        waiting = rewritten.where(~failed).withColumn("query", F.col("new_query")).select(*[c for c in waiting.columns])
    return done


def fan_out(plans: DataFrame) -> DataFrame:
    """query_id, sub_questions to a row for each sub-question with its position."""
    return plans.select("query_id", F.posexplode("sub_questions").alias("pos", "question"))


def fan_in(answers: DataFrame) -> DataFrame:
    """query_id, answers in order, sources: sorted union; single: one answer passes through unchanged."""
    df = answers.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "answer"))).alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return df.select("query_id", F.col("a.answer").alias("answers"), "sources", (F.size("a") == 1).alias("single"))


def merged_timings(a: Column, b: Column) -> Column:
    """Seconds by step, added up where both maps have the step."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
