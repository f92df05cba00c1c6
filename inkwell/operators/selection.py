"""Choosing, ordering and joining rows: small operators over layers, detections, assets and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the file names of decorative images contain.
DECORATIVE = "logo|icon|favicon|banner|button|arrow|bg|background|header|footer|nav|menu|thumb_small|pixel|spacer|sprite|badge|avatar"
#: Patterns of ids by kind.
ID_PATTERNS = {"document": "^[a-z][a-z0-9_]{0,63}$", "variant": r"^variant_[a-zA-Z0-9_\-]+$", "block": r"^p\d+_b\d+$"}
#: File extensions and content types by kind of asset.
EXTENSIONS = {"pdf": ["pdf"], "image": ["jpg", "jpeg", "png", "tif", "tiff"]}
CONTENT_TYPES = {"pdf": "application/pdf", "image": "image/jpeg|image/png|image/tiff"}


def annotations_of(pages: DataFrame, page: str, kind: str | None = None, stage: str | None = None) -> DataFrame:
    """page, block_id and the annotations of blocks (array of structs with annotations, whose structs have type and
    current_stage) of one type or stage; a missing stage counts as 'none'."""
    rows = pages.select(page, F.inline("blocks")).select(page, "block_id", F.explode("annotations").alias("a")).select(page, "block_id", "a.*")
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    return rows if stage is None else rows.where(F.coalesce("current_stage", F.lit("none")) == stage)


def by_reading_order(blocks: DataFrame, page: str, last: int = 999) -> DataFrame:
    """blocks with rank: by reading_order, those without one last, then by pos."""
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.coalesce("reading_order", F.lit(last)), "pos")))


def blocks_to_run(blocks: DataFrame, wanted: DataFrame | None = None, key: str = "block_id") -> DataFrame:
    """Blocks that are not to be skipped, of the wanted ids if there are any given."""
    rows = blocks.where(~F.coalesce("skip", F.lit(False)))
    return rows if wanted is None else rows.join(wanted.select(key).distinct(), key, "left_semi")


def detections_above(rows: DataFrame, threshold: float, without: list[str], strict: bool = False) -> DataFrame:
    """Detections of other classes with a confidence of the threshold or more; above it only, if strict."""
    enough = F.col("conf") > threshold if strict else F.col("conf") >= threshold
    return rows.where(enough & ~F.coalesce(F.col("cls").isin(without), F.lit(False)))


def text_changed(snapshot: Column, current: Column) -> Column:
    """Whether both texts are there and differ."""
    return F.coalesce((snapshot != "") & (current != "") & (snapshot != current), F.lit(False))


def contaminated(paths: DataFrame, repo: str, path: str) -> DataFrame:
    """repo, files: the tracked paths of a repository that lie in its own .git folder, in order; clean ones have no row."""
    inside = F.col(path).startswith(".git/") | (F.col(path) == ".git")
    return paths.where(inside).groupBy(repo).agg(F.sort_array(F.collect_list(path)).alias("files"))


def decorative(url: Column) -> Column:
    """Whether the file name of a URL is that of a decorative image."""
    name = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), "([^/]*)$", 1)
    return name.rlike(f"(?i)({DECORATIVE})")


def download_kind(url: Column, content_type: Column) -> Column:
    """pdf, image or null: by the extension of the URL's path, else by the content type."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit(None).cast("string")
    for name in reversed(EXTENSIONS):
        kind = F.when(F.lower(content_type).rlike(CONTENT_TYPES[name]), name).otherwise(kind)
    for name, known in reversed(EXTENSIONS.items()):
        kind = F.when(ext.isin(known), name).otherwise(kind)
    return kind


def search_variants(edges: DataFrame, text: str = "", by_count: bool = False, most: int = 500) -> DataFrame:
    """rank, a, b, n of the first `most` variant pairs (a < b) of which either side contains the text; n is how many
    variants a has. In order of the characters, or of n."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    n = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pairs = both.where("a < b").where(F.contains("a", F.lit(text)) | F.contains("b", F.lit(text))).join(n, "a")
    order = [F.desc("n"), "a", "b"] if by_count else ["a", "b"]
    top = pairs.orderBy(*order).limit(most)  # a page of a table: most rows at any size
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "a", "b", "n")


def related(documents: DataFrame, interpretations: DataFrame, key: str, source: str) -> DataFrame:
    """Each document with the interpretations made from it."""
    return documents.join(interpretations.withColumnRenamed(source, key), key)


def selected(assets: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return assets.join(chosen.select(key).distinct(), key, "left_semi")


def longest_first(words: DataFrame, dictionary: str, word: str, pos: str) -> DataFrame:
    """words with rank within their dictionary: longer ones first, equal lengths in the order of pos."""
    return words.withColumn("rank", F.row_number().over(Window.partitionBy(dictionary).orderBy(F.desc(F.char_length(word)), pos)))


def joined_in_order(rows: DataFrame, key: str, order: list[str], text: str, separator: str = "") -> DataFrame:
    """key, text: the texts of a key in order, joined."""
    gathered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(gathered, lambda x: x[text]), separator).alias("text"))


def right_to_left(lines: DataFrame, page: str, key: str) -> DataFrame:
    """Vertical lines with rank: from the right edge of a page, that is by x1 falling."""
    return lines.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("x1"), key)))


def groups_in_columns(groups: DataFrame, page: str, key: str, width: float = 50.0) -> DataFrame:
    """groups (cx, cy) with rank: columns from the right, downwards within a column. Centres of a page begin a new
    column where they are more than `width` from the next one to the right, so columns are islands: the pairwise rule
    'by cx unless within width' is not transitive."""
    right = Window.partitionBy(page).orderBy(F.desc("cx"), key)
    begins = F.coalesce((F.lag("cx").over(right) - F.col("cx") > width).cast("int"), F.lit(0))
    columns = groups.withColumn("begins", begins).withColumn("column", F.sum("begins").over(right))
    return columns.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy("column", "cy", key))).drop("begins")


def distinct_matches(matches: DataFrame, keys: tuple[str, ...] = ("headword", "dict", "pos")) -> DataFrame:
    return matches.dropDuplicates(list(keys))


def valid_id(value: Column, kind: str) -> Column:
    return F.coalesce(value.rlike(ID_PATTERNS[kind]), F.lit(False))


def any_of(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    """The keys that are in any of the sets, each once."""
    out = sets[0].select(*keys)
    for s in sets[1:]:
        out = out.unionByName(s.select(*keys))
    return out.distinct()


def not_composed(blocks: DataFrame, composed: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that no text block was made from yet."""
    return blocks.join(composed.select(*keys).distinct(), keys, "left_anti")
