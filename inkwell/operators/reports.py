"""Summaries of pages, blocks and datasets, and texts and pages put together from layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import alignment as al
from . import selection as se
from . import texts as tx

#: Markers of block types in a page's text.
BLOCK_TYPES = {"本文": "main_text", "注釈": "annotation"}


def separation_stats(lines: DataFrame, group: str) -> DataFrame:
    """group and the numbers of its lines: all, of the original, of the translation, and blank ones. lines have class."""
    blank = F.trim("line") == ""
    of = lambda c: F.count_if(~blank & (F.col("class") == c))
    return lines.groupBy(group).agg(F.count(F.lit(1)).alias("total_lines"), of("original").alias("original_lines"), of("translation").alias("translation_lines"), F.count_if(blank).alias("skipped_lines"))


def block_texts(lines: DataFrame, block: str) -> DataFrame:
    """block, avg_confidence (of all characters; 0 without any), char_count, full_text of lines (line_no, text, conf: an
    array with a value per character)."""
    gathered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    total, n = F.sum(F.aggregate("conf", F.lit(0.0), lambda a, c: a + c)), F.sum(F.size("conf"))
    return lines.groupBy(block).agg(F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("avg_confidence"), F.sum(F.char_length("text")).alias("char_count"), F.array_join(F.transform(gathered, lambda x: x["text"]), "\n").alias("full_text"))


def page_summary(blocks: DataFrame, page: str) -> DataFrame:
    """page, total, processed and skipped blocks, and status: partial if any block has an error."""
    n = F.count(F.lit(1))
    return blocks.groupBy(page).agg(n.alias("total_blocks"), F.count_if(~F.col("skip") & F.col("error").isNull()).alias("processed_blocks"), F.count_if("skip").alias("skipped_blocks"), F.when(F.count("error") == 0, "completed").otherwise("partial").alias("status"))


def class_histogram(objects: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """kind, value, n: how often each value of some columns occurs."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds)))
    return objects.select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def boxes_per_page(objects: DataFrame, page: str, width: float) -> DataFrame:
    """bin, n: pages by how many boxes they have, in bins of a width."""
    per = objects.groupBy(page).agg(F.count(F.lit(1)).alias("boxes"))
    return per.groupBy(F.floor(F.col("boxes") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confidence_percent(rows: DataFrame, group: str, confidence: str) -> DataFrame:
    return rows.groupBy(group).agg(F.round(F.avg(confidence) * 100).cast("int").alias("percent"))


def marks_summary(marks: DataFrame, page: str) -> DataFrame:
    """page, summary: a heading per block with marks, and a line per mark (start, end, before, after; in order of seq)."""
    parts = F.filter(F.array(F.concat(F.lit("before:"), F.nullif("before", F.lit(""))), F.concat(F.lit("after:"), F.nullif("after", F.lit("")))), lambda p: p.isNotNull())
    line = F.concat(F.lit("  ["), "start", F.lit("-"), "end", F.lit("] "), F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("(empty)"))
    rows = marks.select(page, "block_id", "seq", line.alias("line"))
    blocks = rows.groupBy(page, "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    block = F.concat(F.lit("[block "), "block_id", F.lit("]\n"), "lines")
    return blocks.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", block.alias("text")))), lambda x: x["text"]), "\n\n").alias("summary"))


def split_of(key: Column, train_percent: int) -> Column:
    """train or test by a hash of the key: the same at every run and size."""
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < train_percent, "train").otherwise("test")


def coco(objects: DataFrame, page: str, train_percent: int = 80) -> DataFrame:
    """Annotations in the shape of object-detection datasets: id, image_id, category, bbox (x, y, width, height), area,
    split (a page lies in one)."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return objects.select("id", F.col(page).alias("image_id"), F.col("cls").alias("category"), F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), split_of(F.col(page), train_percent).alias("split"))


def segments(text: Column) -> Column:
    """array<struct<type, text>> of a page's text at its markers [本文] and [注釈]: trimmed, without empty ones; what
    comes before the first marker is main text."""
    pattern = r"\[(" + "|".join(BLOCK_TYPES) + r")\]"
    kinds = F.concat(F.array(F.lit(next(iter(BLOCK_TYPES)))), F.regexp_extract_all(text, F.lit(pattern), 1))
    names = F.create_map(*(F.lit(x) for kv in BLOCK_TYPES.items() for x in kv))
    pairs = F.zip_with(kinds, F.split(text, pattern, -1), lambda k, s: F.struct(F.element_at(names, k).alias("type"), F.regexp_replace(s, r"^\s+|\s+$", "").alias("text")))
    return F.filter(pairs, lambda p: p["text"] != "")


def page_offsets(texts: DataFrame, corrections: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """corrections with char_index counted from the text's beginning where they give a line; those of lines that are not
    there are left out."""
    lines = F.split(F.col(text_col), "\n")
    rows = corrections.join(texts.select(key, lines.alias("lines_")), key)
    begin = F.when(F.col("line").isNull() | (F.col("line") == 0), 0).otherwise(F.char_length(F.array_join(F.slice("lines_", F.lit(1), F.greatest(F.col("line"), F.lit(0))), "\n")) + 1)
    there = F.col("line").isNull() | ((F.col("line") >= 0) & (F.col("line") < F.size("lines_")))
    return rows.where(there).withColumn("char_index", (F.col("char_index") + begin).cast("int")).drop("lines_", "line")


def corrected_blocks(texts: DataFrame, blocks: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """key, pos, block_id, block_type, original_text, corrected_text, n_applied: a page's text by its blocks.

    Corrections without a block_id count in the page, others in their block. With markers the text's segments go to the
    blocks in order (more segments than blocks make extra blocks); without, the first block has all of it.
    """
    page_level = page_offsets(texts, corrections.where("block_id is null").drop("block_id"), key)
    both = texts.join(tx.apply_corrections(texts, page_level, key), key)
    cut = lambda c: F.when(F.col(c).rlike(r"\[(" + "|".join(BLOCK_TYPES) + r")\]"), segments(F.col(c)))
    metas = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "block_type"))).alias("metas"))
    rows = both.join(metas, key).select(key, "metas", "text", "corrected", cut("text").alias("own"), cut("corrected").alias("new"))
    n = F.when(F.col("own").isNull(), F.size("metas")).otherwise(F.size("own"))
    rows = rows.select("*", F.explode(F.filter(F.sequence(F.lit(0), n), lambda i: i < n)).alias("pos"))
    meta, whole = F.try_element_at("metas", F.col("pos") + 1), F.when(F.col("pos") == 0, F.col("text")).otherwise("")
    own = F.when(F.col("own").isNull(), whole).otherwise(F.try_element_at("own", F.col("pos") + 1)["text"])
    new = F.when(F.col("new").isNull(), F.when(F.col("pos") == 0, F.col("corrected")).otherwise("")).otherwise(F.coalesce(F.try_element_at("new", F.col("pos") + 1)["text"], own))
    kind = F.coalesce(meta["block_type"], F.try_element_at("own", F.col("pos") + 1)["type"])
    rows = rows.select(key, "pos", F.coalesce(meta["block_id"], F.format_string("extra_b%02d", F.col("pos") + 1)).alias("block_id"), kind.alias("block_type"), own.alias("original_text"), new.alias("text"))
    rows = rows.withColumn("block", F.struct(key, "block_id"))
    inner = corrections.where("block_id is not null").withColumn("block", F.struct(key, "block_id"))
    done = tx.apply_corrections(rows, page_offsets(rows, inner, "block"), "block")
    counts = inner.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(done.select("block", "corrected"), "block").join(counts, "block", "left")
    changed = (F.col("original_text") != F.col("text")).cast("int")
    return rows.select(key, "pos", "block_id", "block_type", "original_text", F.col("corrected").alias("corrected_text"), (F.coalesce("n", F.lit(0)) + changed).alias("n_applied"))


def page_alignment(lines: DataFrame, refs: DataFrame, variants: DataFrame, page: str, block: str) -> DataFrame:
    """page, block and alignment_stats of every block's recognised text with the part of the page's text most like it,
    and of the whole page (block '*'). lines: page, block, pos (of the block), line_no, text; refs: page, text; variants:
    a, b. Line breaks don't count, and texts are put in composed form; blocks without text are left out."""
    of_block = lines.withColumn("key", F.struct(page, block)).groupBy("key").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "").alias("ocr"))
    of_block = of_block.where("ocr <> ''").withColumn("ocr", al.nfc("ocr")).select(F.col(f"key.{page}").alias(page), F.col(f"key.{block}").cast("string").alias(block), "pos", "ocr")
    clean = refs.select(page, al.nfc(F.translate("text", "\n\r", "")).alias("ref"))
    window = of_block.join(clean, page).withColumn("w", al.best_window("ocr", "ref"))
    parts = window.select(page, block, "ocr", F.substring("ref", F.col("w.start") + 1, F.col("w.length")).alias("ref"))
    whole = se.joined_in_order(of_block, page, ["pos", block], "ocr").withColumnRenamed("text", "ocr").join(clean, page).select(page, F.lit("*").alias(block), "ocr", "ref")
    return al.text_stats(parts.unionByName(whole), [page, block], variants)


def sidecars(pages: DataFrame, page: str) -> DataFrame:
    """page, kind, content of what is written beside an imported page: text, marks, formatting and translation, as JSON
    where it is a list; none where there is nothing."""
    listed = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    kinds = {"text": F.nullif(F.col("text"), F.lit("")), "marks": listed("marks"), "formatting": listed("formatting"), "translation": F.nullif(F.trim("translation"), F.lit(""))}
    rows = pages.select(page, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("content")) for k, c in kinds.items()))).alias("s")).select(page, "s.kind", "s.content")
    return rows.where("content is not null")


def write_sidecars(pages: DataFrame, page: str, path: str) -> None:
    """sidecars as JSON lines, a folder per kind."""
    sidecars(pages, page).write.mode("overwrite").partitionBy("kind").json(path)


def dictionary_list(files: DataFrame, name: str, json: str) -> DataFrame:
    """name, title, n of dictionary files: the entries their statistics give, else those they hold."""
    parsed = F.from_json(json, "title string, statistics struct<total_entries: bigint>, entries array<struct<headword: string>>")
    return files.select(name, parsed.alias("d")).select(name, F.coalesce("d.title", F.col(name).cast("string")).alias("title"), F.coalesce(F.col("d.statistics.total_entries"), F.size("d.entries").cast("bigint")).alias("n"))


def variant_lines(edges: DataFrame) -> DataFrame:
    """line: `a,b` once for each unordered pair of variants."""
    return edges.select(F.concat_ws(",", F.least("a", "b"), F.greatest("a", "b")).alias("line")).distinct()


def citation_scan(files: DataFrame, path: str, json: str) -> DataFrame:
    """path, pos, page_number (0 if the file has none) and fields of the marks of all files; files that are no JSON have
    none."""
    parsed = F.from_json(json, "page_number int, marks array<struct<id: string, status: string, label: string>>")
    rows = files.select(path, parsed.alias("f")).select(path, F.coalesce("f.page_number", F.lit(0)).alias("page_number"), F.posexplode("f.marks").alias("pos", "m"))
    return rows.select(path, "pos", "page_number", "m.*")


def has_text_layer(pages: DataFrame, document: str, first: int = 3, least: int = 10) -> DataFrame:
    """document, has_text: whether one of its first pages has more than `least` characters."""
    enough = (F.char_length(F.trim("text")) > least) & (F.col("page_num") <= first)
    return pages.groupBy(document).agg(F.coalesce(F.bool_or(enough), F.lit(False)).alias("has_text"))


def layers_as_of(versions: DataFrame, path: str, block: Column, page: Column, cut: Column) -> DataFrame:
    """Of each path the last version (by version) not after the cut, of the page's block files; where a page has none,
    of its one page file. versions: path, version, content; page and block are of the path (block null for a page
    file)."""
    w = Window.partitionBy(path).orderBy(F.desc("version"))
    now = versions.where(F.col("version") <= cut).withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")
    now = now.withColumns({"page": page, "block": block})
    has_blocks = now.where("block is not null").select("page").distinct()
    return now.where("block is not null").unionByName(now.where("block is null").join(has_blocks, "page", "left_anti"))


def import_stats(pages: DataFrame, source: str) -> DataFrame:
    """source, pages_saved, chars, flagged (any page), page_count (the largest page), mean_chars of imported pages (page,
    chars, flag)."""
    return pages.groupBy(source).agg(F.count(F.lit(1)).alias("pages_saved"), F.sum("chars").alias("chars"), F.bool_or("flag").alias("flagged"), F.max("page").alias("page_count"), F.round(F.avg("chars"), 4).alias("mean_chars"))


def holdings(rows: DataFrame, work: str, holder: str) -> DataFrame:
    """work, n, holders: who holds a work, each once, in order of their names."""
    return rows.groupBy(work).agg(F.count_distinct(holder).alias("n"), F.array_join(F.sort_array(F.collect_set(F.col(holder).cast("string"))), ",").alias("holders"))


def dictionary_size(edges: DataFrame) -> DataFrame:
    """size (characters that have variants) and pair_count (unordered pairs) of a symmetric dictionary."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.agg(F.count_distinct("a").alias("size"), F.count_distinct(F.struct(F.least("a", "b"), F.greatest("a", "b"))).alias("pair_count"))
