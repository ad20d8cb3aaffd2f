"""Queries on pushed bytes and on walks called from SQL, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from sonaril.operators import signals
from sonaril.plans.catalog import query, raw
from sonaril.plans.stages import _run_stream

_FILES = "SELECT CAST(doc_id // 100 AS VARCHAR) || '.ogg' AS name, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id, md5(text)) - 1 AS packet_no, md5(text) AS payload FROM documents WHERE text IS NOT NULL"


@query(_FILES)
def growing_files(spark, sf):
    """Documents as packets of files, a hundred a file, read as a stream of what the files have gained."""
    from sonaril.session import shared_folder
    from sonaril.sources import growing, mux

    base = f"{shared_folder(spark)}/growing-{uuid.uuid4().hex[:12]}"
    d = raw(spark, sf).groupBy(F.concat(F.floor(F.col("doc_id") / 100).cast("string"), F.lit(".ogg")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.md5("b").alias("h"), "b"))).alias("p"))

    def write(batches):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(f"{base}/in")
        system.create_dir(path, recursive=True)
        for b in batches:
            for name, packets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{path}/{name}") as f:
                    f.write(mux.ogg_pages([p["b"] for p in packets]))
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["name"])

    d.mapInArrow(write, "name string").count()
    growing.register(spark)
    pieces = spark.readStream.format("growing").option("path", f"{base}/in").option("ending", ".ogg").option("piece", "100000").load()
    return _run_stream(spark, growing.ogg_packet_stream(pieces), base).select("name", "packet_no", F.md5("payload").alias("payload"))


@query("SELECT CAST(doc_id AS VARCHAR) AS stream_id, CAST(count(*) AS BIGINT) AS fragments, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT doc_id, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND octet_length(encode(text)) < 255 * 250 UNION ALL SELECT doc_id, octet_length(encode(lang)) FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND octet_length(encode(text)) < 255 * 250) GROUP BY 1")
def lateral_walk(spark, sf):
    """Container walks called from SQL: fragments of two-packet files of a page."""
    from sonaril.sources import growing, mux

    growing.register_walks(spark)
    d = signals.table(spark, sf, "documents").filter("text IS NOT NULL AND lang IS NOT NULL AND octet_length(text) < 255 * 250").select("doc_id", F.encode("text", "utf-8").alias("a"), F.encode("lang", "utf-8").alias("b"))
    view = f"files_{uuid.uuid4().hex[:12]}"
    mux.ogg_files(d, "doc_id", ["a", "b"]).createOrReplaceTempView(view)
    return spark.sql(f"SELECT stream_id, count(*) AS fragments, sum(octet_length(data)) AS bytes FROM {view}, LATERAL ogg_fragments(content) GROUP BY stream_id")
