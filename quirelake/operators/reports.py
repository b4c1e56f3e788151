"""Reports, guards and states of runs and jobs as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import tables as T
from quirelake.functions.numbers import strict_number
from quirelake.functions.text import sheet_token, strip
from quirelake.operators.contract import row_style
from quirelake.plans.order import bucketed_prefix_sum

# Kinds of artifacts by name and suffix, first match first.
ARTIFACTS = ((r"(^|/)manifest\.json$", "manifest"), (r"(^|/)run_summary\.md$", "summary"), (r"(?i)\.json$", "json"), (r"(?i)\.md$", "markdown"), (r"(?i)\.xlsx$", "excel"), (r"(?i)\.pdf$", "pdf"))
# Drawings that hold no bill of materials.
NO_TARGET = "COVER|DWG LIST|물량|SUPPORT_물량"
COMPARED = "_compare"


def batch_rollup(runs: DataFrame, batch: str, ok: str, rows: str) -> DataFrame:
    """(batch, ok, failed, rows_ok, mean_rows, without_rows): rows count over good runs, the mean over all."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return runs.groupBy(batch).agg(
        F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col(rows))), F.lit(0)).cast("long").alias("rows_ok"),
        F.round(F.avg(rows), 4).alias("mean_rows"), F.count_if(F.col(rows) == 0).alias("without_rows"),
    )


def compare_runs(baseline: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, baseline, after, change_pct); a baseline of 0 has no change."""
    a, b = baseline.select(key, F.col(value).alias("baseline")), after.select(key, F.col(value).alias("after"))
    pct = F.when(F.col("baseline") == 0, 0.0).otherwise((F.col("after") - F.col("baseline")) / F.col("baseline") * 100)
    return a.join(b, key, "full_outer").select(key, "baseline", "after", F.round(pct, 4).alias("change_pct"))


def artifacts(paths: DataFrame, path: str, case: str) -> DataFrame:
    """(path, kind, compared, role, target, prefixed, safe) of artifact paths."""
    p, steps = F.col(path), F.split(path, "/")
    kind = F.lit("other")
    for pattern, name in reversed(ARTIFACTS):
        kind = F.when(p.rlike(pattern), name).otherwise(kind)
    compared = F.array_contains(steps, COMPARED)
    return paths.select(path, kind.alias("kind"), compared.alias("compared"), F.when(compared, "diagnostic").otherwise("representative").alias("role"), (~F.upper(p).rlike(NO_TARGET)).alias("target"), F.concat_ws("/", F.lit(case), p).alias("prefixed"), (~(p.startswith("/") | F.array_contains(steps, ".."))).alias("safe"))


def within(size: Column, most: int) -> Column:
    """Whether an input's size is allowed; null for an unknown one."""
    return size <= most


def is_pdf(name: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def text_sheet(sections: DataFrame) -> DataFrame:
    """(doc_id, row_no, title, text): the text rows of a sheet, below its header row.

    The row is the section's place in its document, so sections without text leave a gap.
    """
    one = sections.groupBy("doc_id", "section_ord").agg(F.min(F.struct(F.col("title").isNull(), "title", F.col("clean_text").isNull(), "clean_text")).alias("s"))
    w = Window.partitionBy("doc_id").orderBy("section_ord")
    rows = one.select("doc_id", (F.row_number().over(w) + 1).cast("long").alias("row_no"), F.coalesce("s.title", F.lit("")).alias("title"), F.col("s.clean_text").alias("text"))
    return rows.filter(F.col("text").isNotNull() & (strip(F.regexp_replace("text", r"(?U)\s+", "")) != ""))


def latest_entries(entries: DataFrame, path: str, order: list[str], value: str) -> DataFrame:
    """(path, value, entries): of the entries of one path the last under `order`; no sort, one aggregate."""
    return entries.groupBy(path).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("entries"))


def qa_report(verdicts: DataFrame) -> DataFrame:
    """(line_no, line): the worst verdict, then the counts of all, largest first."""
    c = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    worst = c.agg(F.when(F.count_if(F.col("verdict") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("verdict") == "WARN") > 0, "WARN").otherwise("PASS").alias("v"))
    lines = c.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "verdict", "n"))).alias("l")).select(F.posexplode("l").alias("i", "x"))  # one entry a verdict
    return worst.select(F.lit(0).alias("line_no"), F.concat(F.lit("# QA: "), "v").alias("line")).unionByName(lines.select((F.col("i") + 1).alias("line_no"), F.format_string("- %s: %d", "x.verdict", "x.n").alias("line")))


def job_states(calls: DataFrame, most: int) -> DataFrame:
    """(job_id, status, span, over_capacity) from the calls of each job."""
    j = calls.groupBy("job_id").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count_if(F.col("status") == "error").alias("e"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("e") == F.col("n"), "failed").when(F.col("e") > 0, "partial").otherwise("done")
    return j.select("job_id", status.alias("status"), (F.col("b") - F.col("a") + 1).alias("span"), (F.col("b") - F.col("a") >= most).alias("over_capacity"))


def serve_calls(calls: DataFrame, order: str, keys: int, quota: int, exhausted: tuple[int, ...] = ()) -> DataFrame:
    """`calls` with n, their place in order from 1, and slot, the key that serves them.

    Keys serve `quota` calls in turn; the turn of an exhausted key goes to the next one that is not.
    """
    n = bucketed_prefix_sum(calls.withColumn("_one", F.lit(1)), [], F.floor(F.col(order) / 10_000), [order], "_one", "_before")
    n = n.withColumn("n", F.col("_before") + 1).drop("_one", "_before")
    live = [next((k + i) % keys for i in range(keys) if (k + i) % keys not in exhausted) for k in range(keys)]
    turn = F.pmod(F.floor((F.col("n") - 1) / F.lit(quota)), F.lit(keys)).cast("int")
    return n.withColumn("slot", F.element_at(F.array(*[F.lit(k) for k in live]), turn + 1))


# Titles that name nothing, names of the sheets of known tables, and labels of table types.
NO_TITLES = ("doc", "inline_text")
ROLE_SHEETS = {"source_info_table": "업체정보", "material_quantity_table": "물량산출표"}
TYPE_LABELS = {"A_품셈": "품셈", "B_규모기준": "규모기준", "C_구분설명": "설명", "D_기타": "설명"}


def type_label(kind: Column, default: str) -> Column:
    out = F.lit(default)
    for k, label in TYPE_LABELS.items():
        out = F.when(kind == k, label).otherwise(out)
    return out


def sheet_name(role: Column, section_title: Column, title: Column, label: Column) -> Column:
    """Base name of a table's sheet: by its role, its section with the label of its type, its title, or the label."""
    out = F.lit(None).cast("string")
    for r, name in ROLE_SHEETS.items():
        out = F.when(role == r, name).otherwise(out)
    section, own = sheet_token(section_title), sheet_token(title)
    says = lambda t: (t != "") & ~F.lower(t).isin(*NO_TITLES)
    of_section = F.when((label != "") & ~section.contains(label), F.concat_ws("_", section, label)).otherwise(section)
    return F.coalesce(out, F.when(says(section), of_section).when(says(own), own).otherwise(label))


def material_sheet_name(role: Column, kind: Column, section_title: Column, title: Column) -> Column:
    line = F.coalesce(role == "line_list_table", F.lit(False)) | F.coalesce(kind == "BOM_LINE_LIST", F.lit(False))
    return F.when(line, "BOM_LINE_LIST").otherwise(sheet_name(role, section_title, title, type_label(kind, "BOM_자재표")))


def is_rate_limit(error: Column) -> Column:
    return F.coalesce(error.contains("429") | F.lower(error).rlike("quota|rate limit"), F.lit(False))


def fallback_mode(asked: Column, never: Column) -> Column:
    """auto, always or never; unknown ones are auto, and a plain no wins."""
    return F.when(F.coalesce(never, F.lit(False)), "never").when(asked.isin("auto", "always", "never"), asked).otherwise("auto")


def token_counts(response: Column) -> Column:
    """struct(input_tokens, output_tokens) of an answer's JSON text, 0 where it says nothing."""
    n = lambda *paths: F.coalesce(*[F.get_json_object(response, p).try_cast("long") for p in paths], F.lit(0).cast("long"))
    return F.struct(n("$.usage_metadata.prompt_token_count").alias("input_tokens"), n("$.usage_metadata.candidates_token_count").alias("output_tokens"))


def reserved_name(base: Column, taken: Column) -> Column:
    """`base`, or base_1, base_2, ..., the first that `taken`, the names in use, does not hold."""
    n = F.size(taken)
    tries = F.transform(F.sequence(F.lit(1), n + 1), lambda k: F.concat_ws("_", base, k.cast("string")))
    free = F.filter(tries, lambda t: ~F.array_contains(taken, t))
    return F.when(~F.array_contains(taken, base), base).otherwise(free[0])


#: From this column on (from 1) the cells of an estimate sheet are numbers where they read as such.
NUMBERS_FROM = 5


def estimate_sheet(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, col_no, text, number, style) of the cells of estimate sheets.

    Row 1 is the title and row 2 the headers of a sheet; the table's rows follow,
    each section, subtotal or body, then one row of notes if there are any.
    """
    t = tables.filter(F.size("headers") > 0)
    body = t.select(*keys, "headers", F.posexplode("rows").alias("i", "row")).withColumn("style", row_style(F.col("row"), F.col("headers")))
    cells = body.select(*keys, (F.col("i") + 3).alias("row_no"), "style", F.posexplode(T.pad(F.col("row"), F.size("headers"))).alias("j", "text"))
    text = strip(F.coalesce("text", F.lit("")))
    cells = cells.select(*keys, "row_no", (F.col("j") + 1).alias("col_no"), text.alias("text"), F.when(F.col("j") + 1 >= NUMBERS_FROM, strict_number(text)).alias("number"), "style")
    heads = t.select(*keys, F.posexplode("headers").alias("j", "text")).select(*keys, F.lit(2).alias("row_no"), (F.col("j") + 1).alias("col_no"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("double").alias("number"), F.lit("header").alias("style"))
    noted = t.filter(F.size("notes") > 0).select(*keys, (F.size("rows") + 3).alias("row_no"), F.lit(1).alias("col_no"), F.concat(F.lit("※ "), F.array_join("notes", " / ")).alias("text"), F.lit(None).cast("double").alias("number"), F.lit("note").alias("style"))
    return cells.unionByName(heads).unionByName(noted)


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """(run_id, entries, representative, diagnostic, failed) of a manifest's entries by the role they were given."""
    return manifest.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("role") == "representative").alias("representative"), F.count_if(F.col("role") == "diagnostic").alias("diagnostic"),
        F.count_if(F.coalesce(F.col("quality_status") == "fail", F.lit(False))).alias("failed"),
    )


def representative_jsons(manifest: DataFrame, domain: str = "bom") -> DataFrame:
    """(run_id, json): the files that are rolled up: representative entries of a domain, those of comparisons left out, once each."""
    own = (F.col("role") == "representative") & (F.col("domain") == domain) & F.col("json").isNotNull()
    return manifest.filter(own & ~F.array_contains(F.split("json", "/"), COMPARED)).select("run_id", "json").distinct()
