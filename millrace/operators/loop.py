"""The bounded loop of fixes: propose, check syntax, judge, revise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import providers
from millrace.operators.syntax import check_syntax
from millrace.sources.shared import cut

MOST_REVISIONS = 2


def run(findings: DataFrame, make: Callable[[], providers.Provider] = providers.Stub, most: int = MOST_REVISIONS) -> DataFrame:
    """findings: review_id, finding_id, title, path, code. One row a finding: the last fix, flags, attempts made and judged.

    Accepted fixes leave the loop. Only those with valid syntax are judged, in a branch of their own. After ``most`` revisions
    a last attempt is made and not judged.
    """
    agent, empty = providers.Agent(make), F.lit("")
    open_rows = findings.withColumn("feedback", empty).withColumn("attempts", F.lit(0)).withColumn("judged", F.lit(0))
    done = None
    for revision in range(most + 1):
        fixed = agent.suggest(open_rows)
        fixed = cut(fixed.withColumn("attempts", F.col("attempts") + 1).withColumn("syntax", check_syntax(F.col("proposed_fix"), F.col("path"))))
        if revision == most:
            last = fixed.withColumn("accepted", F.lit(None).cast("boolean")).withColumn("feedback", F.lit(f"Maximum revisions ({most}) reached."))
            done = last if done is None else done.unionByName(last)
            break
        wrong = fixed.where("not syntax.valid").withColumn("accepted", F.lit(False))
        language = T.language(F.col("path"))["name"]
        wrong = wrong.withColumn("feedback", F.format_string("Syntax error detected: %s. Please provide syntactically valid %s code.", F.col("syntax.error"), language))
        judged = agent.critique(fixed.where("syntax.valid")).withColumn("judged", F.col("judged") + 1)
        both = cut(judged.unionByName(wrong))
        accepted = both.where("accepted")
        done = accepted if done is None else done.unionByName(accepted)
        open_rows = both.where("not accepted").select(*findings.columns, "feedback", "attempts", "judged")
        if open_rows.isEmpty():
            break
    return done


def review_state(fixes: DataFrame, key: str = "review_id") -> DataFrame:
    """Whether any fix of a review was rejected, and the feedback in one text."""
    rejected = ~F.coalesce("accepted", F.lit(True))
    tagged = F.when(rejected, F.format_string("[%s]: %s", "title", "feedback"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("finding_id", tagged.alias("t")))), lambda x: x["t"])
    return fixes.groupBy(key).agg(F.bool_or(rejected).alias("any_rejected"), F.array_join(F.array_compact(lines), " | ").alias("feedback"))
