"""References in texts: commits, issues, links, sections and files, and what they resolve to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment as S

# The shapes of references, the earlier ones first.
KINDS = {
    "url": r"https?://[^\s<>\"')\]]+",
    "issue": r"(?<![A-Za-z0-9_/])[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#[0-9]+|(?<![A-Za-z0-9_&/])#[0-9]+",
    "sha": r"(?<![0-9A-Za-z_])[0-9a-f]{7,40}(?![0-9A-Za-z_])",
    "branch": r"(?<![A-Za-z0-9_/.-])(?:feature|fix|bugfix|release|hotfix)/[A-Za-z0-9_./-]*[A-Za-z0-9]",
}


def valid_sha(token: Column) -> Column:
    """Hexadecimal digits with at least one digit and one letter."""
    return token.rlike("^[0-9a-f]{7,40}$") & token.rlike("[0-9]") & token.rlike("[a-f]")


def sha_references(docs: DataFrame) -> DataFrame:
    """doc_id, token of words that can name a commit."""
    words = F.filter(F.split("text", "[^A-Za-z0-9_]+", -1), lambda w: w.rlike("^[0-9a-f]{7,40}$"))
    return docs.select("doc_id", F.explode(words).alias("token")).where(valid_sha(F.col("token")))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, token>> of a pattern's matches, from the lengths of what stands between them."""
    tokens = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.transform(F.split(text, pattern, -1), F.length)
    total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + x)
    places = lambda ts, gaps, sizes: F.transform(ts, lambda t, i: F.struct((total(gaps, i + 1) + total(sizes, i)).alias("start"), t.alias("token")))
    return S.let(tokens, lambda ts: S.let(between, lambda gaps: S.let(F.transform(ts, F.length), lambda sizes: places(ts, gaps, sizes))))


def references(docs: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """doc_id, kind, start, token: matches that do not overlap; of overlapping ones the kind named first wins, then the earlier one."""
    kinds = kinds or KINDS
    found = F.concat(*(F.transform(_places(F.col("text"), p), _tagged(rank, kind)) for rank, (kind, p) in enumerate(kinds.items())))
    rows = docs.select("doc_id", F.array_sort(found).alias("found"))
    start = F.array().cast("array<struct<rank: int, start: int, kind: string, token: string>>")

    def step(kept: Column, m: Column) -> Column:
        meets = F.exists(kept, lambda k: (m["start"] < k["start"] + F.length(k["token"])) & (k["start"] < m["start"] + F.length(m["token"])))
        bad = (m["kind"] == "sha") & ~valid_sha(m["token"])
        return F.when(meets | bad, kept).otherwise(F.array_append(kept, m))

    return rows.select("doc_id", F.explode(F.aggregate("found", start, step)).alias("m")).select("doc_id", "m.kind", "m.start", "m.token")


def _tagged(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), F.lit(kind).alias("kind"), m["token"].alias("token"))


def resolved_references(found: DataFrame, known: DataFrame) -> DataFrame:
    """found(doc_id, kind, token) with url from known(kind, token, url); null where the target does not exist."""
    return found.join(known, ["kind", "token"], "left")


def used_refs(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, repo, ref, kind, default_branch: each owner/repo@ref of a text, and what refs(repo, ref, kind, default_branch) says of it."""
    uses = F.regexp_extract_all("text", F.lit(r"(?m)uses:\s*([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+@[A-Za-z0-9_./-]+)"), 1)
    rows = docs.select("doc_id", F.explode(uses).alias("use"))
    rows = rows.select("doc_id", F.regexp_extract("use", "^([^/@]+/[^/@]+)", 1).alias("repo"), F.substring_index("use", "@", -1).alias("ref"))
    rows = rows.join(refs.select("repo", "ref", "kind"), ["repo", "ref"], "left")
    branches = refs.groupBy("repo").agg(F.max("default_branch").alias("default_branch"))
    return rows.join(branches, "repo", "left").select("doc_id", "repo", "ref", F.coalesce("kind", F.lit("missing")).alias("kind"), F.coalesce("default_branch", F.lit("main")).alias("default_branch"))


def anchor(heading: Column) -> Column:
    """The link name of a heading: lower case, blanks to hyphens, other marks dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(heading)), r"[^\p{L}\p{N} _-]", ""), " ", "-")


def slug(heading: Column, words: int = 3) -> Column:
    """The first words of a heading that have a letter or digit, joined by hyphens."""
    kept = F.filter(F.split(F.lower(heading), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.array_join(F.slice(kept, 1, words), "-")


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, number, title, anchor of headings that open with a section number."""
    rows = S.lines(docs).where(F.col("line").rlike(r"^#{1,6} +\d+(\.\d+)*\.? "))
    title = F.regexp_replace("line", r"^#+ +", "")
    return rows.select("doc_id", "line_no", F.regexp_extract("line", r"^#+ +(\d+(?:\.\d+)*)", 1).alias("number"), title.alias("title"), anchor(title).alias("anchor"))


#: A citation: a document's name in front, or none for the text's own sections, and a number.
CITATION = r"(?:(?<![\w./-])([\w./-]*\w\.(?:md|txt|rst|adoc)),? )?(?:§ ?|[Ss]ections? )(\d+(?:\.\d+)*)"


def named_documents(names: DataFrame, docs: DataFrame) -> DataFrame:
    """names(name) with target, the doc_id of the one document of docs(doc_id, path) whose path ends in that name, part by part.

    Each path stands under all its ends, so a name is one equi-join, with nothing to compare; a name that
    several paths end in, unless one is that path itself, names none.
    """
    parts = F.split(F.regexp_replace("path", r"^\./", ""), "/")
    ends = docs.where("path is not null").select("doc_id", parts.alias("p")).select("doc_id", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    ends = ends.select("doc_id", F.array_join(F.slice("p", F.col("k"), F.size("p")), "/").alias("name"), (F.col("k") == 1).alias("whole"))
    best = ends.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("one"), F.sum(F.col("whole").cast("int")).alias("n_whole"), F.min(F.when(F.col("whole"), F.col("doc_id"))).alias("itself"))
    target = F.when(F.col("n_whole") == 1, F.col("itself")).when(F.col("n") == 1, F.col("one"))
    found = best.select("name", target.alias("target")).where("target is not null")
    return names.withColumn("name", F.regexp_replace("name", r"^(?:\.{1,2}/)+", "")).join(found, "name", "left")


def section_citations(docs: DataFrame) -> DataFrame:
    """doc_id, name, number, target, anchor: each section number that a text cites, of itself or of the document that it names.

    docs has doc_id, text and, where documents are named, path. target is the cited document, null
    where no one document has that name; anchor its heading of that number, the first if there are
    several, null where there is none.
    """
    cited = F.regexp_extract_all("text", F.lit(f"({CITATION})"), 1)
    rows = docs.select("doc_id", F.explode(cited).alias("c")).select("doc_id", F.regexp_extract("c", CITATION, 1).alias("name"), F.regexp_extract("c", CITATION, 2).alias("number"))
    own = rows.where("name = ''").withColumn("target", F.col("doc_id"))
    others = rows.where("name != ''")
    others = named_documents(others, docs) if "path" in docs.columns else others.withColumn("target", F.lit(None).cast("long"))
    first = headings(docs).groupBy("doc_id", "number").agg(F.min_by("anchor", "line_no").alias("anchor"))
    found = own.unionByName(others).join(first.withColumnRenamed("doc_id", "target"), ["target", "number"], "left")
    return found.select("doc_id", "name", "number", "target", "anchor")


# Conclusions of a check that did not pass, and of one that is still to come.
CHECK_FAILED = ["FAILURE", "ERROR", "TIMED_OUT", "CANCELLED", "ACTION_REQUIRED", "STARTUP_FAILURE"]
CHECK_PENDING = ["PENDING", "EXPECTED"]


def pull_state(state: Column, mergeable: Column, merge_state: Column, checks: Column) -> Column:
    """The state of a pull request, the gravest first: what is finished, then defects, then chores, then waiting.

    Null checks are none; null fields hold nothing against the request.
    """
    any_of = lambda values: F.coalesce(F.exists(checks, lambda c: c.isin(values)), F.lit(False))
    conflict = F.coalesce(mergeable == "CONFLICTING", F.lit(False)) | F.coalesce(merge_state == "DIRTY", F.lit(False))
    return (
        F.when(state == "MERGED", "merged").when(state == "CLOSED", "closed").when(any_of(CHECK_FAILED), "failing")
        .when(conflict, "conflict").when(any_of(CHECK_PENDING), "pending").otherwise("ready")
    )


def query_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def without_query_parameter(url: Column, name: str) -> Column:
    """The URL without one query parameter."""
    cut = F.regexp_replace(url, rf"([?&]){name}=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"([?&])&+", "$1"), r"[?&](#|$)", "$1"), r"&&+", "&")


def has_credentials(url: Column) -> Column:
    return url.rlike(r"https?://[^/\s@]+@")
