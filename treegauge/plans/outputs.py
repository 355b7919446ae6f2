"""What leaves an audit: badges, cards, a text report, a digest, JSON documents and lists; all are columns of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.functions import rules as R
from treegauge.functions import text as T

ORDER = ("quality", "security", "testing", "documentation", "maintainability")


def text_width(text: Column) -> Column:
    """Of small print: 7 a character, half of it for a space or a middle dot."""
    narrow = F.char_length(text) - F.char_length(F.regexp_replace(text, "[ ·]", ""))
    return F.floor(F.char_length(text) * 7.0 - narrow * 3.5 + 0.5).cast("int")


def _tag(name: str, body: Column | None = None, **attributes: Column | str | int) -> Column:
    """An element of a drawing; attributes and body are expressions or fixed."""
    bits = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        bits += [F.lit(f' {k.replace("_", "-")}="'), v.cast("string") if isinstance(v, Column) else F.lit(str(v)), F.lit('"')]
    return F.concat(*bits, F.lit("/>")) if body is None else F.concat(*bits, F.lit(">"), body, F.lit(f"</{name}>"))


def badge(graded: DataFrame, label: str = "health") -> DataFrame:
    """(repo_id, value, width, colour, svg) for (repo_id, overall, grade)."""
    value = F.format_string("%s · %d%%", "grade", "overall")
    l, r = text_width(F.lit(label)) + 16, text_width(value) + 16
    colour = T.band(F.col("grade"), "badge")
    words = lambda body, x: _tag("text", body, x=x, y=14, fill="#fff", text_anchor="middle", font_size=11)
    svg = _tag("svg", F.concat(_tag("rect", width=l, height=20, fill="#555"), _tag("rect", x=l, width=r, height=20, fill=colour), words(F.lit(label), l / 2), words(value, l + r / 2)), xmlns="http://www.w3.org/2000/svg", width=l + r, height=20)
    return graded.select("repo_id", value.alias("value"), (l + r).cast("int").alias("width"), colour.alias("colour"), svg.alias("svg"))


def duel(scores: DataFrame, graded: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, category, score_a, score_b, diff, told) for pairs (a, b) of repositories; a category without findings scores 100."""
    every = graded.select("repo_id", F.explode(F.array(*map(F.lit, ORDER))).alias("category")).join(scores.select("repo_id", "category", "score"), ["repo_id", "category"], "left").fillna(100, ["score"])
    side = lambda s: every.select(F.col("repo_id").alias(s), "category", F.col("score").alias(f"score_{s}"))
    x = pairs.join(side("a"), "a").join(side("b"), ["b", "category"]).withColumn("diff", F.col("score_a") - F.col("score_b"))
    told = F.when(F.col("diff") == 0, "tie").when(F.col("diff") > 0, F.concat(F.lit("A +"), F.col("diff").cast("string"))).otherwise(F.concat(F.lit("B +"), (-F.col("diff")).cast("string")))
    return x.select("a", "b", "category", "score_a", "score_b", "diff", told.alias("told"))


def verdict(rows: DataFrame, graded: DataFrame) -> DataFrame:
    """(a, b, wins_a, wins_b, overall_a, overall_b, grade_a, grade_b, verdict): who wins more categories, whatever the overall."""
    g = rows.groupBy("a", "b").agg(F.sum(F.when(F.col("diff") > 0, 1).otherwise(0)).alias("wins_a"), F.sum(F.when(F.col("diff") < 0, 1).otherwise(0)).alias("wins_b"))
    for s in ("a", "b"):
        g = g.join(graded.select(F.col("repo_id").alias(s), F.col("overall").alias(f"overall_{s}"), F.col("grade").alias(f"grade_{s}")), s)
    who = F.when(F.col("wins_a") > F.col("wins_b"), F.col("a").cast("string")).otherwise(F.col("b").cast("string"))
    points = F.when(F.col("overall_a") == F.col("overall_b"), "equal overall").otherwise(F.format_string("%d%% against %d%% overall", F.greatest("overall_a", "overall_b"), F.least("overall_a", "overall_b")))
    even = F.format_string("even, %d categories each, %d%% against %d%% overall", "wins_a", "overall_a", "overall_b")
    won = F.format_string("%s wins %d of %d categories, %s", T.shortened(who, 40), F.greatest("wins_a", "wins_b"), F.lit(len(ORDER)), points)
    return g.select("a", "b", "wins_a", "wins_b", "overall_a", "overall_b", "grade_a", "grade_b", F.when(F.col("wins_a") == F.col("wins_b"), even).otherwise(won).alias("verdict"))


def card(rows: DataFrame, verdicts: DataFrame, wide: int = 250) -> DataFrame:
    """(a, b, svg): both sides with grade and colour, mirrored bars for each category, and the verdict."""
    k = F.array_position(F.array(*map(F.lit, ORDER)), F.col("category"))
    y = k * 44 + 190
    bar = lambda s: F.greatest(F.lit(6), F.floor(F.col(f"score_{s}") / 100 * wide + 0.5)).cast("int")
    label = F.create_map(*[F.lit(x) for pair in R.LABELS.items() for x in pair])[F.col("category")]
    won = lambda when: F.when(when, "#34d399").otherwise("#526180")
    line = F.concat(
        _tag("rect", x=350 - bar("a"), y=y, width=bar("a"), height=14, fill=won(F.col("diff") > 0)),
        _tag("rect", x=510, y=y, width=bar("b"), height=14, fill=won(F.col("diff") < 0)),
        _tag("text", label, x=430, y=y + 6, text_anchor="middle"),
        _tag("text", F.col("told"), x=430, y=y + 20, text_anchor="middle"),
    )
    lines = rows.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("x")))), lambda s: s["x"]), "").alias("lines"))
    name = lambda s: T.xml(T.shortened(F.col(s).cast("string"), 28))
    head = lambda s, x, anchor: F.concat(_tag("text", name(s), x=x, y=98, text_anchor=anchor), _tag("text", F.concat(F.col(f"overall_{s}").cast("string"), F.lit("% "), F.col(f"grade_{s}")), x=x, y=160, text_anchor=anchor, fill=T.band(F.col(f"grade_{s}"), "card")))
    body = F.concat(head("a", 44, "start"), head("b", 816, "end"), F.col("lines"), _tag("text", T.xml(F.col("verdict")), x=430, y=450, text_anchor="middle"))
    return verdicts.join(lines, ["a", "b"]).select("a", "b", _tag("svg", body, xmlns="http://www.w3.org/2000/svg", width=860, height=500).alias("svg"))


def _lines(df: DataFrame, by: list[Column], line: Column, most: int, name: str) -> DataFrame:
    """(repo_id, name, name_n): the first `most` lines of a repository as one text, and how many there are."""
    w = Window.partitionBy("repo_id")
    top = df.select("repo_id", F.row_number().over(w.orderBy(*by)).alias("k"), F.count(F.lit(1)).over(w).alias("n"), line.alias("x")).where(F.col("k") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), "\n")
    return top.groupBy("repo_id").agg(joined.alias(name), F.max("n").alias(f"{name}_n"))


def text_report(graded: DataFrame, scores: DataFrame, found: DataFrame, plan: DataFrame) -> DataFrame:
    """(repo_id, report): the grade, a bar of twenty for each category, the first 15 findings and 5 plan items."""
    every = graded.select("repo_id", F.explode(F.array(*map(F.lit, ORDER))).alias("category")).join(scores.select("repo_id", "category", "score"), ["repo_id", "category"], "left").fillna(100, ["score"])
    full = F.floor(F.col("score") / 5 + 0.5).cast("int")
    label = F.create_map(*[F.lit(x) for pair in R.LABELS.items() for x in pair])[F.col("category")]
    bar = F.concat(F.rpad(label, 16, " "), F.lit(" "), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 20 - full), F.lit(" "), F.lpad(F.col("score").cast("string"), 3, " "), F.lit("%"))
    bars = _lines(every, [F.array_position(F.array(*map(F.lit, ORDER)), F.col("category"))], bar, 5, "bars")
    first = _lines(found, [F.col("seq")], F.concat(F.lit("  ["), F.rpad(F.upper("severity"), 8, " "), F.lit("] "), "title", F.lit("  -"), F.col("penalty").cast("string")), 15, "found")
    next_ = _lines(plan, [F.col("place")], F.concat(F.lit("  "), F.col("place").cast("string"), F.lit(". ["), "impact", F.lit("/"), "effort", F.lit("] "), "title"), 5, "next")
    x = graded.join(bars, "repo_id").join(first, "repo_id", "left").join(next_, "repo_id", "left")
    more = F.when(F.col("found_n") > 15, F.concat(F.lit("  and "), (F.col("found_n") - 15).cast("string"), F.lit(" more")))
    head = F.format_string("overall: %d/100 (grade %s)", "overall", "grade")
    return x.select("repo_id", F.concat_ws("\n", head, "bars", F.format_string("findings (%d):", F.coalesce("found_n", F.lit(0))), "found", more, F.lit("plan:"), "next").alias("report"))


def digest(graded: DataFrame, scores: DataFrame, stats: DataFrame, found: DataFrame, plan: DataFrame) -> DataFrame:
    """(repo_id, digest) for a writer of prescriptions: grade, categories, size, the first 30 findings, the plan. stats: (repo_id, analysed, loc)."""
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("category"))
    kinds = _lines(scores, [order], F.concat(F.lit("- "), "category", F.lit(": "), F.col("score").cast("string")), 5, "kinds")
    first = _lines(found, [F.col("seq")], F.concat_ws(" | ", F.concat(F.lit("- "), "id"), "severity", "title"), 30, "found")
    next_ = _lines(plan, [F.col("place")], F.concat(F.lit("- ["), "impact", F.lit("/"), "effort", F.lit("] "), "title"), 12, "next")
    x = graded.join(stats, "repo_id").join(kinds, "repo_id", "left").join(first, "repo_id", "left").join(next_, "repo_id", "left")
    lines = F.concat_ws("\n", F.concat(F.lit("repository: "), F.col("repo_id").cast("string")), F.format_string("overall: %d (grade %s)", "overall", "grade"), "kinds", F.format_string("size: %d files, %d lines", "analysed", "loc"), F.lit("findings:"), "found", F.lit("plan:"), "next")
    return x.select("repo_id", lines.alias("digest"))


def overview(results: DataFrame, cycles: int = 4, deps: int = 10) -> DataFrame:
    """(id, part, place, text) of stored results: the first cycles of modules, and the first dependencies with advisories and how many each has."""
    some = lambda c, n, text: F.transform(F.slice(F.coalesce(c, F.array().cast(dict(results.select(c.alias("c")).dtypes)["c"])), 1, n), text)
    loops = some(F.col("architecture.cycles"), cycles, lambda x, i: F.struct(F.lit("cycle").alias("part"), (i + 1).alias("place"), F.array_join(x, " > ").alias("text")))
    bad = some(F.col("vulnerableDeps"), deps, lambda x, i: F.struct(F.lit("dependency").alias("part"), (i + 1).alias("place"), F.concat(x["name"], F.lit("@"), x["version"], F.lit(" "), F.size(x["vulns"]).cast("string")).alias("text")))
    return results.select("id", F.explode(F.concat(loops, bad)).alias("x")).select("id", "x.*")


def status(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, body) of jobs (job_id, status, result_id, ...): the job as JSON, with the document of results (result_id, document) where it is done and has one."""
    job = F.struct(*[F.col("job_id").alias("id"), *[F.col(c) for c in jobs.columns if c != "job_id"]])
    x = jobs.withColumn("job", F.to_json(job)).join(results.select("result_id", "document"), "result_id", "left")
    whole = F.when((F.col("status") == "done") & F.col("document").isNotNull(), F.concat(F.lit('{"job":'), "job", F.lit(',"result":'), "document", F.lit("}")))
    return x.select("job_id", F.coalesce(whole, F.concat(F.lit('{"job":'), "job", F.lit("}"))).alias("body"))


def listed(results: DataFrame) -> DataFrame:
    """(id, owner, repo, overall, grade, analyzed_at) of stored results: only these fields are read."""
    return results.select("id", "repo.owner", F.col("repo.name").alias("repo"), "scores.overall", "scores.grade", F.col("analyzedAt").alias("analyzed_at"))
