"""From captured pages to notes, the manifest and files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import html, urls
from notemill.functions import text as tx
from notemill.operators import batch, documents, robots, toc
from notemill.sources import files


def site_notes(pages: DataFrame, at: str, prefix: str = "https://", exclude: str | None = None, rules: DataFrame | None = None, authorized: list[str] | None = None, done: DataFrame | None = None, only: str | None = None, limit: int | None = None, key: str = "page_id") -> DataFrame:
    """A note a page in scope: key, url, file, title, note, status, error.

    What decides by address alone comes first (scope, repeats, robots, numbering, resume), so pages that don't count
    are never parsed; then one Python pass a page reads title and Markdown."""
    own = pages.withColumn("_url", urls.normalize(F.col("url"))).where(urls.in_scope(F.col("_url"), prefix, exclude))
    small = toc.first_seen(own.select(key, "_url"), ["_url"], [key])
    if rules is not None:
        met = robots.evaluate(small.withColumn("host", urls.host(F.col("_url"))), rules, url="_url", key=key)
        small = robots.gate(met, authorized or [], url="_url").select(key, "_url")
    tree = toc.url_tree(small, F.lit(prefix), seq=key, url="_url")
    tree = tree.select(key, "_url", toc.output_path(F.col("titles"), F.col("positions")).alias("file"), tx.path_text(F.col("titles")).alias("path"))
    if done is not None:
        tree = batch.resume(tree, done.withColumnRenamed("url", "_url"), key="_url")
    if only:
        tree = tree.where(F.concat("path", F.lit(" "), "_url").rlike(tx.rxi(only)))
    if limit is not None:
        tree = tree.orderBy(key).limit(limit)
    read = pages.join(tree, key).select(key, "_url", "file", html.page(F.col("html")).alias("p"))
    title, body = F.col("p.title"), F.col("p.markdown")
    empty = tx.strip(F.coalesce(body, F.lit(""))) == ""
    note = F.concat(tx.front_matter(title, F.col("_url"), F.lit(at)), tx.with_title(title, body))
    return read.select(key, F.col("_url").alias("url"), "file", title.alias("title"), F.when(~empty, note).alias("note"), F.when(empty, "error").otherwise("ok").alias("status"), F.when(empty, "ValueError: página sem texto").alias("error"))


def manifests(items: DataFrame, by: list[str], seq: str, cols: list[str]) -> DataFrame:
    """A run's items as one JSON text, in order."""
    rows = items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(seq, *(c for c in cols if c != seq)))).alias("items"))
    return rows.select(*by, F.to_json(F.struct("items")).alias("manifest"))


def repo_notes(found: DataFrame, repo: str, branch: str, at: str, path: str = "path", content: str = "content") -> DataFrame:
    """found: files.repo_files() with content (bytes), assets among them. Gives path, file, title, chars, status, error, note
    and, for an asset, its bytes as they are (asset true, no title or note). Bytes that aren't UTF-8 become U+FFFD."""
    p = F.col(path)
    dirs = F.split(F.regexp_extract(p, r"^(.*)/[^/]*$", 1), "/")
    dirs = F.filter(dirs, lambda x: x != "")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folders = F.transform(dirs, lambda x: tx.slugify(x, 60))
    raw = F.decode(F.col(content), "UTF-8")
    markdown = F.when(F.lower(name).endswith(".ipynb"), documents.notebook_markdown(raw)).otherwise(F.concat(tx.strip(raw), F.lit("\n")))
    own = found.select(p.alias("path"), "asset", F.col(content).alias("bytes"), folders.alias("folders"), name.alias("name"), stem.alias("stem"), tx.path_text(dirs).alias("module"), F.when(~F.col("asset"), markdown).alias("markdown"))
    bad = F.when(F.col("markdown").isNull(), "ValueError: notebook ilegível").when(tx.strip(F.col("markdown")) == "", "ValueError: arquivo sem conteúdo")
    own = own.withColumn("error", F.when(~F.col("asset"), bad))
    title = F.when(~F.col("asset") & F.col("error").isNull(), tx.first_heading(F.col("markdown"), F.translate("stem", "_-", "  ")))
    own = own.withColumn("title", title).withColumn("file", F.array_join(F.concat("folders", F.array(F.when(F.col("asset"), F.col("name")).otherwise(F.concat(tx.slugify(F.col("stem"), 60), F.lit(".md"))))), "/"))
    front = tx.front_matter(F.col("title"), urls.blob_url(F.lit(repo), F.lit(branch), F.col("path")), F.lit(at), F.col("module"))
    return own.select("path", "file", "asset", "title", F.when(F.col("title").isNotNull(), F.char_length("markdown")).alias("chars"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error", F.concat(front, "markdown").alias("note"), F.when(F.col("asset"), F.col("bytes")).alias("bytes"))


def export(notes: DataFrame, root: str, file: str = "file", note: str = "note") -> DataFrame:
    """Writes each note to its file below root; gives file, chars. Rows without a note write nothing."""
    return _written(notes.where(F.col(note).isNotNull()).select(file, F.encode(F.col(note), "UTF-8").alias(note)), root, file, note, "chars")


def export_files(rows: DataFrame, root: str, file: str = "file", content: str = "content") -> DataFrame:
    """Writes bytes as they are (assets, pictures, a former run's files); gives file, bytes. Rows without bytes write nothing."""
    return _written(rows.where(F.col(content).isNotNull()).select(file, content), root, file, content, "bytes")


def copied_run(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies all files of a run's folder, but for empty ones, below another one; gives path, bytes."""
    return export_files(files.scan_folder(spark, source), target, "path")


def _written(rows: DataFrame, root: str, file: str, content: str, told: str) -> DataFrame:
    """root: a folder that all executors see, a path or an address that Arrow's file systems know. A file is written under
    another name and then renamed, so a task that runs twice leaves a whole one. Paths may not leave root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath
        import uuid

        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        base = base.rstrip("/")
        for b in batches:
            sizes = []
            for name, data in zip(b[file], b[content]):
                to = posixpath.normpath(f"{base}/{name}")
                if not to.startswith(base + "/") or name.startswith("/"):
                    raise ValueError(f"path outside the folder: {name}")
                folder, last = posixpath.split(to)
                fs.create_dir(folder, recursive=True)
                part = f"{folder}/.{last}.{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, to)
                sizes.append(len(data.decode()) if told == "chars" else len(data))
            yield pd.DataFrame({file: b[file], told: sizes})

    return rows.mapInPandas(run, f"{file} string, {told} long")
