"""Counts, accuracies, comparisons and issue lists over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.responses import usage
from ..functions.rules import blank, error_category, unmapped
from .numbering import numbered


def share(part: Column, all_: Column, times: float = 1.0) -> Column:
    """part / all_, 0 if there are none."""
    return F.when(all_ > 0, times * part / all_).otherwise(F.lit(0.0))


def mapping_summary(results: DataFrame) -> DataFrame:
    """One row of counts over results (method, model_used, pass, confidence, threshold)."""
    valid = F.col("confidence") >= F.col("threshold")
    direct, string = F.col("method") == "DirectIdMatch", (F.col("method") == "AiNameMatching") & (F.col("model_used") == "StringMatching")
    scored = (F.col("method") == "AiNameMatching") & ~string
    counts = {"processed": F.count("*"), "matched": F.count_if(valid), "direct": F.count_if(direct), "string": F.count_if(string), "ai_pass_1": F.count_if(scored & (F.col("pass") == 1)), "ai_pass_2": F.count_if(scored & (F.col("pass") == 2))}
    row = results.agg(*[c.alias(k) for k, c in counts.items()])
    return row.select("*", (F.col("ai_pass_1") + F.col("ai_pass_2")).alias("ai_total"), (F.col("direct") + F.col("string")).alias("first_round"), (F.col("processed") - F.col("matched")).alias("unmapped"))


def token_usage(answers: DataFrame, metadata: str = "metadata", by: tuple[str, ...] = ()) -> DataFrame:
    used = answers.select(*by, usage(F.col(metadata)).alias("u"))
    return used.groupBy(*by).agg(*[F.coalesce(F.sum(f"u.{k}"), F.lit(0)).cast("long").alias(k) for k in ("calls", "prompt", "completion", "total")])


def error_count(answers: DataFrame, metadata: str = "metadata") -> DataFrame:
    return answers.agg(F.count_if(F.map_contains_key(metadata, "error")).alias("errors"))


def benchmark_metrics(rows: DataFrame, by: str = "model") -> DataFrame:
    """Accuracy, mean time, and mean confidence over predicted positives, of tests (by, expected, predicted, confidence, ms)."""
    hit = (F.col("predicted") == F.col("expected")).cast("int")
    metrics = [F.count("*").alias("tests"), F.sum(hit).cast("long").alias("correct"), F.avg(hit).alias("accuracy"), F.avg("ms").alias("avg_ms"), F.coalesce(F.avg(F.when(F.col("predicted"), F.col("confidence"))), F.lit(0.0)).alias("avg_confidence")]
    return rows.groupBy(by).agg(*metrics)


def threshold_sweep(rows: DataFrame, by: str = "preset", steps: int = 100) -> DataFrame:
    """What each threshold 0, 1/steps, ... 1 would give, by preset, in one pass over results (by, expected, confidence): by, threshold, tests,
    accepted (confidence at or above it), right (accepted and expected), accuracy, precision (1 if none is accepted) and recall (1 if none
    is expected).

    Confidences are counted by step; a threshold takes in all steps from it on. What comes together for a preset is its steps, not
    its rows. Null confidences count as 0, those beyond 0 and 1 as the nearer of the two; null as expected counts as false.
    """
    step = F.floor(F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * steps + 1e-9).cast("int")
    yes = F.coalesce(F.col("expected"), F.lit(False)).cast("long")
    counted = rows.groupBy(by, step.alias("step")).agg(F.count("*").alias("n"), F.sum(yes).alias("y"))
    presets = counted.groupBy(by).agg(F.sum("n").alias("tests"), F.sum("y").alias("positives"))
    grid = presets.select(by, "tests", "positives", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    counted = counted.withColumnRenamed(by, "__by")
    full = grid.join(counted, F.col("__by").eqNullSafe(F.col(by)) & (grid["step"] == counted["step"]), "left").select(by, "tests", "positives", grid["step"], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("y", F.lit(0)).alias("y"))
    after = Window.partitionBy(by).orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    full = full.withColumns({"accepted": F.sum("n").over(after), "right": F.sum("y").over(after)})
    accuracy = (F.col("right") + (F.col("tests") - F.col("accepted")) - (F.col("positives") - F.col("right"))) / F.col("tests")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return full.select(by, (F.col("step") / steps).alias("threshold"), "tests", "accepted", "right", accuracy.alias("accuracy"), share("right", "accepted").alias("precision"), share("right", "positives").alias("recall"))


def face_metrics(rows: DataFrame, by: str = "model") -> DataFrame:
    """The same of detections (by, expected faces, found, confidence, ms): a picture counts as 0 or 1 faces."""
    return benchmark_metrics(rows.select(by, (F.col("expected") == F.col("found").cast("int")).alias("expected"), F.lit(True).alias("predicted"), F.when(F.col("found"), F.col("confidence")).alias("confidence"), "ms"), by)


def first_rows(rows: DataFrame, by: str, order: str, k: int = 10) -> DataFrame:
    """At most k rows of each model, as results keep them."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("k") <= k).drop("k")


def best_models(metrics: DataFrame, order: str = "model") -> DataFrame:
    """The most accurate and the fastest model, the first of equals."""
    best = metrics.agg(F.min_by(order, F.struct(-F.col("accuracy"), order)).alias("most_accurate"), F.min_by(order, F.struct("avg_ms", order)).alias("fastest"))
    return best


def pick_model(metrics: DataFrame, model: str | None, col: str = "model", order: str = "position") -> DataFrame:
    """One model's row, in any case of its name; without a name the first."""
    rows = metrics.where(F.lower(col) == model.lower()) if model else metrics
    return rows.orderBy(order).limit(1)


def compare_models(baseline: DataFrame, candidate: DataFrame, model: str | None = None) -> DataFrame:
    """(metric, baseline, candidate, delta) of a model's rows; no rows if either side lacks it."""
    names = ["accuracy", "avg_ms", "avg_confidence", "tests"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")
    a, b = (pick_model(x, model).select(pairs).select("m.metric", F.col("m.value").alias(s)) for x, s in ((baseline, "baseline"), (candidate, "candidate")))
    return a.join(b, "metric").withColumn("delta", F.col("candidate") - F.col("baseline"))


def compare_all(baseline: DataFrame, candidate: DataFrame, by: str = "model") -> DataFrame:
    """The same for all models that both runs have, in any case of their names."""
    names = ["accuracy", "avg_ms", "avg_confidence", "tests"]
    a, b = baseline.withColumn("__k", F.lower(by)).alias("a"), candidate.withColumn("__k", F.lower(by)).alias("b")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"a.{n}").cast("double").alias("baseline"), F.col(f"b.{n}").cast("double").alias("candidate")) for n in names])).alias("m")
    return a.join(b, "__k").select(F.col(f"a.{by}").alias(by), each).select(by, "m.*", (F.col("m.candidate") - F.col("m.baseline")).alias("delta"))


def team_issues(teams: DataFrame) -> DataFrame:
    """Failed and skipped teams, and completed ones with unmapped players: status, message, whether it is critical, details."""
    missing = unmapped(F.col("extracted"), F.col("mapped"))
    some = (F.col("status") == "Completed") & (missing > 0)
    message = F.when(F.col("status") == "Completed", F.concat(F.lit("Unmapped players: "), missing.cast("string"))).otherwise(F.col("message"))
    details = F.when(some, F.array_join(F.coalesce("unmapped_names", F.array().cast("array<string>")), ", ")).otherwise("")
    rows = teams.where(F.col("status").isin("Failed", "Skipped") | some)
    return rows.select("team", "status", message.alias("message"), ((F.col("status") == "Failed") | some).alias("critical"), details.alias("details"))


def batch_summary(teams: DataFrame) -> DataFrame:
    missing = F.when(F.col("status") == "Completed", unmapped(F.col("extracted"), F.col("mapped"))).otherwise(0)
    row = teams.agg(
        F.count_if(F.col("status") == "Failed").alias("failed"), F.count_if(F.col("status") == "Skipped").alias("skipped"), F.count_if(missing > 0).alias("unmapped_teams"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("unmapped_players"), F.coalesce(F.sum("extracted"), F.lit(0)).cast("long").alias("players"), F.coalesce(F.sum("mapped"), F.lit(0)).cast("long").alias("mapped"),
    )
    part = lambda n, text: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), text))
    parts = F.concat_ws(", ", part("failed", F.lit(" failed")), part("skipped", F.lit(" skipped")), part("unmapped_players", F.concat(F.lit(" unmapped players ("), F.col("unmapped_teams").cast("string"), F.lit(" teams)"))))
    title = F.when(parts == "", "Issues: none").otherwise(F.concat(F.lit("Issues: "), parts, F.lit("; mapped "), F.col("mapped").cast("string"), F.lit("/"), F.col("players").cast("string")))
    return row.withColumn("title", title)


def issue_counts(issues: DataFrame, label: str = "label", detail: str = "detail", most: int = 50) -> DataFrame:
    """(label, n, details) of each kind of issue; details are a preview, its first `most` in order. issue_details has them all."""
    counts = issues.groupBy(label).agg(F.count("*").alias("n"))
    first = issues.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(detail))).where(F.col("k") <= most)
    told = first.groupBy(F.col(label).alias("__l")).agg(F.array_sort(F.collect_list(detail)).alias("d"))
    return counts.join(told, counts[label].eqNullSafe(told["__l"])).select(label, "n", F.array_join("d", ", ").alias("details"))


def issue_details(issues: DataFrame, label: str = "label", detail: str = "detail") -> DataFrame:
    """(label, place, detail) of every issue, in order within its kind: rows, so that a kind can have any number of them."""
    return numbered(issues.select(label, detail), [label], [detail]).select(label, "place", detail)


def photo_grid(states: DataFrame, missing: DataFrame) -> DataFrame:
    """Counts of photos by state, and of players without a photo."""
    names = ["total", "mapped", "not_in_csv", "no_id", "csv_without_photo"]
    n = lambda s: F.count_if(F.col("state") == s)
    photos = states.agg(*[c.alias(k) for c, k in zip((F.count("*"), n("matched"), n("not_in_csv"), n("no_id"), F.lit(0).cast("long")), names, strict=True)])
    players = missing.agg(*[(F.count("*") if k == names[-1] else F.lit(0).cast("long")).alias(k) for k in names])
    return photos.unionByName(players).agg(*[F.sum(k).alias(k) for k in names])


def validation_status(reference: DataFrame, photos: DataFrame, same: Column) -> DataFrame:
    """(external_id, reference_name, photo_name, status) of either side's ids: correct or incorrect by `same`, missing, extra.

    reference: external_id, reference_name; photos: external_id, photo_name; `same` speaks of the two names.
    """
    rows = reference.join(photos, "external_id", "full_outer")
    status = F.when(F.col("photo_name").isNull(), "missing").when(F.col("reference_name").isNull(), "extra").when(same, "correct").otherwise("incorrect")
    return rows.withColumn("status", status).select("external_id", F.coalesce("reference_name", F.lit("")).alias("reference_name"), F.coalesce("photo_name", F.lit("")).alias("photo_name"), "status")


def team_accuracy(rows: DataFrame, team: str = "team") -> DataFrame:
    """Counts by status and two accuracies, in percent: of reference players, and of all rows; a total row has a null team."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = rows.rollup(team).agg(n("correct"), n("incorrect"), n("missing"), n("extra"), F.count("*").alias("rows"))
    players = F.col("correct") + F.col("incorrect") + F.col("missing")
    return out.withColumn("accuracy", share(F.col("correct"), players, 100.0)).withColumn("accuracy_of_rows", share(F.col("correct"), F.col("rows"), 100.0))


def ranked_teams(accuracy: DataFrame, team: str = "team") -> DataFrame:
    rows = accuracy.where(F.col(team).isNotNull())
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy_of_rows"), team)))


def problem_teams(accuracy: DataFrame, team: str = "team", least: float = 0.3) -> DataFrame:
    rate = share(F.col("incorrect"), F.col("rows"))
    return accuracy.where(F.col(team).isNotNull()).withColumn("rate", rate).where(F.col("rate") > least)


def error_categories(rows: DataFrame) -> DataFrame:
    """Counts and shares of the reasons why names of incorrect rows differ."""
    kinds = rows.where("status = 'incorrect'").select(error_category(F.col("reference_name"), F.col("photo_name")).alias("category"))
    counts = kinds.groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def coverage(expected: DataFrame, made: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """How many of the expected keys were made, in percent; and how many are missing."""
    a, b = expected.select(*by, key).distinct(), made.select(*by, key).distinct().withColumn("__made", F.lit(True))
    rows = a.join(b, [*by, key], "left").groupBy(*by).agg(F.count("*").alias("expected"), F.count("__made").alias("made"))
    return rows.withColumn("missing", F.col("expected") - F.col("made")).withColumn("percent", share(F.col("made"), F.col("expected"), 100.0))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only, or of both."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(True)), right.select(key).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def mean_kb(files: DataFrame, length: str = "length", by: tuple[str, ...] = ()) -> DataFrame:
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.round(F.avg(length) / 1024, 2).alias("mean_kb"))


def top_sizes(files: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent widths and heights."""
    return files.groupBy("width", "height").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width", "height").limit(k)


def compare_runs(hashes: DataFrame) -> DataFrame:
    """(run_a, run_b, common, same, different) for each two runs of (run, id, digest). Runs meet by id, so a pair of runs costs
    as much as the ids they share."""
    a, b = hashes.select("id", F.col("run").alias("run_a"), F.col("digest").alias("da")), hashes.select("id", F.col("run").alias("run_b"), F.col("digest").alias("db"))
    both = a.join(b, "id").where("run_a < run_b")
    return both.groupBy("run_a", "run_b").agg(F.count("*").alias("common"), F.count_if(F.col("da") == F.col("db")).alias("same"), F.count_if(F.col("da") != F.col("db")).alias("different"))


def cache_stats(cache: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries, and those whose file is still there."""
    there = listing.select(F.lower("path").alias("__p")).distinct().withColumn("__there", F.lit(1))
    return cache.join(there, F.lower("ImagePath") == F.col("__p"), "left").agg(F.count("*").alias("entries"), F.count("__there").alias("existing"))


def ordered_presets(presets: DataFrame) -> DataFrame:
    """presets (name, width, height) with their place by area, width, height and name in any case, then as spelled."""
    keyed = presets.withColumn("__area", F.col("width").cast("long") * F.col("height")).withColumn("__low", F.lower("name"))
    return numbered(keyed, [], ["__area", "width", "height", "__low", "name"]).drop("__area", "__low")


def ordered_unmapped(players: DataFrame) -> DataFrame:
    """Players with their place by family name, surname and id."""
    return numbered(players, [], ["FamilyName", "SurName", "PlayerId"])


def merged_models(configured: DataFrame, found: DataFrame, col: str = "model") -> DataFrame:
    """Models of both lists, each once in any case, as configured if it is; configured ones first."""
    both = configured.select(col, F.lit(0).alias("rank")).unionByName(found.select(col, F.lit(1).alias("rank"))).where(~blank(F.col(col)))
    return both.groupBy(F.lower(F.trim(col)).alias("k")).agg(F.min(F.struct("rank", col)).alias("m")).select(f"m.{col}", "m.rank")
