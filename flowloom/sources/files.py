"""Text and dissector sources, pushed records, and bundles."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.common import text

FORMAT = 1
#: Secrets that a key log may hold.
KEY_LABELS = ("CLIENT_RANDOM", "CLIENT_EARLY_TRAFFIC_SECRET", "CLIENT_HANDSHAKE_TRAFFIC_SECRET", "SERVER_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0", "EARLY_EXPORTER_SECRET", "EXPORTER_SECRET")
#: Older names of session sources.
SOURCE_KINDS = {
    "SOURCE_KIND_CHROME": "chrome",
    "SOURCE_KIND_MITMPROXY": "mitmproxy",
    "SOURCE_KIND_ANDROID_EMULATOR": "android",
    "SOURCE_KIND_ANDROID_DEVICE": "android",
    "SOURCE_KIND_GENERIC": "import",
    "SOURCE_KIND_UNSPECIFIED": "",
}


def keylog_rows(lines: DataFrame) -> DataFrame:
    """label, client_random, secret of key log lines (value); comments, unknown labels and a cut last line are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("#")).select(parts.alias("p")).filter(F.size("p") == 3)
    rows = rows.select(F.col("p")[0].alias("label"), F.lower(F.col("p")[1]).alias("client_random"), F.lower(F.col("p")[2]).alias("secret"))
    return rows.filter(F.col("label").isin(*KEY_LABELS) & F.col("client_random").rlike("^[0-9a-f]{64}$") & F.col("secret").rlike("^([0-9a-f]{64}|[0-9a-f]{96})$")).distinct()


def read_keylog(spark: SparkSession, path: str) -> DataFrame:
    """label, client_random, secret of the key logs at a path."""
    return keylog_rows(spark.read.text(path))


def read_follow(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, from_client, bytes of a followed raw stream: hex lines, indented ones from the server."""
    lines = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"^\t?[0-9a-fA-F]+$") & (F.length(F.trim(F.regexp_replace("line", "\t", ""))) % 2 == 0)).select("file", "line_no", (~F.col("line").startswith("\t")).alias("from_client"), F.unhex(F.regexp_replace("line", "\t", "")).alias("bytes"))


PDML = "proto array<struct<_name:string,field:array<struct<_name:string,_show:string,_value:string>>>>"


def read_pdml(spark: SparkSession, path: str) -> DataFrame:
    """file, pdu_no, proto, fields (array of name, show, value) of every protocol layer of every packet."""
    packets = spark.read.format("xml").option("rowTag", "packet").schema(PDML).load(path)
    # one packet's layers stay in order; packets are told apart by their own frame number
    number = F.filter(F.flatten(F.transform("proto", lambda p: F.coalesce(p["field"], F.array()))), lambda f: f["_name"] == "frame.number")
    return packets.select(F.try_element_at(number, F.lit(1))["_show"].cast("long").alias("frame_number"), F.posexplode("proto").alias("layer_no", "p")).select("frame_number", "layer_no", F.col("p._name").alias("proto"), F.transform("p.field", lambda f: F.struct(f["_name"].alias("name"), f["_show"].alias("show"), f["_value"].alias("value"))).alias("fields"))


def shown(fields: Column, name: str) -> Column:
    """First shown value of a field, NULL without one."""
    return F.try_element_at(F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: f["show"]), F.lit(1))


def stitch_pdml(layers: DataFrame) -> DataFrame:
    """Exchanges of dissected HTTP/1 layers: stream_id, position, method, uri, status. A stream's n-th request goes with its n-th status
    (parts without a status don't count); HTTP/2 layers pair by (stream, stream id)."""
    from pyspark.sql import Window

    tcp = layers.filter("proto = 'tcp'").select("frame_number", shown(F.col("fields"), "tcp.stream").alias("stream_id"))
    h1 = layers.filter("proto = 'http'").select("frame_number", "layer_no", shown(F.col("fields"), "http.request.method").alias("method"), shown(F.col("fields"), "http.request.uri").alias("uri"), shown(F.col("fields"), "http.response.code").cast("int").alias("status")).join(tcp, "frame_number")
    w = Window.partitionBy("stream_id").orderBy("frame_number", "layer_no")
    q = h1.filter("method IS NOT NULL").select("stream_id", F.row_number().over(w).alias("position"), "method", "uri")
    r = h1.filter("status IS NOT NULL").select("stream_id", F.row_number().over(w).alias("position"), "status")
    one = q.join(r, ["stream_id", "position"], "left")
    h2 = layers.filter("proto = 'http2'").select("frame_number", shown(F.col("fields"), "http2.streamid").alias("sub"), shown(F.col("fields"), "http2.headers.method").alias("method"), shown(F.col("fields"), "http2.headers.path").alias("uri"), shown(F.col("fields"), "http2.headers.status").cast("int").alias("status")).join(tcp, "frame_number")
    two = h2.groupBy(F.concat_ws(":", "stream_id", "sub").alias("stream_id")).agg(F.min_by("method", "frame_number").alias("method"), F.min_by("uri", "frame_number").alias("uri"), F.max("status").alias("status")).filter("method IS NOT NULL")
    return one.unionByName(two.withColumn("position", F.lit(1)))


def from_proxy(exchanges: DataFrame) -> DataFrame:
    """Flow columns of exchanges as a proxy pushes them (request and response structs); a blank id gets a new one."""
    q, r = F.col("request"), F.col("response")
    return exchanges.select(
        F.when(text(F.col("id")) == "", F.uuid()).otherwise(F.col("id")).alias("id"), q["timestamp"].cast("long").alias("ts_micros"), q["method"].alias("method"), q["scheme"].alias("scheme"), q["authority"].alias("authority"), F.split_part(q["path"], F.lit("?"), F.lit(1)).alias("path"),
        F.when(q["path"].contains("?"), F.regexp_replace(q["path"], r"^[^?]*\?", "")).otherwise("").alias("query"), F.coalesce(r["status"], F.lit(0)).cast("int").alias("status"), F.coalesce(r["timestamp"] - q["timestamp"], F.lit(0)).cast("long").alias("duration_micros"), F.coalesce(F.col("error"), F.lit("")).alias("error"),
    )


def from_dns(lookups: DataFrame) -> DataFrame:
    """Flow columns of name lookups (id, ts_micros, qtype, qname, rcode, answers array of strings)."""
    return lookups.select("id", "ts_micros", F.lit("DNS").alias("protocol"), F.col("qtype").alias("method"), F.col("qname").alias("authority"), F.to_json(F.struct(F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))).alias("body"), F.when(text(F.col("rcode")).isin("", "NOERROR"), "").otherwise(F.col("rcode")).alias("error"))


def source_kind(c: Column) -> Column:
    """Old source names as new ones; unknown old names are blank."""
    known = F.create_map(*[x for k, v in SOURCE_KINDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, c), F.when(text(c).startswith("SOURCE_KIND_"), "").otherwise(text(c)))


def export_bundle(tables: dict[str, DataFrame], folder: str, session_id: str) -> None:
    """Tables of a session as parquet with a manifest, which is written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = json.dumps({"format": FORMAT, "session_id": session_id, "tables": sorted(tables)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def import_bundle(spark: SparkSession, folder: str, new_id: str | None = None) -> dict[str, DataFrame]:
    """Tables of a bundle whose format is known; session_id replaced if a new one is given."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    if manifest.get("format") != FORMAT:
        raise ValueError(f"bundle of format {manifest.get('format')!r}")
    out = {}
    for name in manifest["tables"]:
        if not name.isidentifier():
            raise ValueError(f"bad table name {name!r}")
        df = spark.read.parquet(f"{folder}/{name}")
        out[name] = df.withColumn("session_id", F.lit(new_id)) if new_id and "session_id" in df.columns else df
    return out


def merge_definitions(catalog: DataFrame, bundle: DataFrame) -> DataFrame:
    """The catalog's definitions (tags or groups) with those of an imported bundle that it lacks, by id; of a bundle's repeats one."""
    fresh = bundle.dropDuplicates(["id"]).join(catalog.select("id"), "id", "left_anti")
    return catalog.unionByName(fresh, allowMissingColumns=True)


def export_files(spark: SparkSession, paths: dict[str, str], folder: str) -> None:
    """Raw members of a bundle (capture, key log, spilled bodies), by name, beside its tables."""
    for name, path in paths.items():
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.startswith("."):
            raise ValueError(f"bad member name {name!r}")
        spark.read.format("binaryFile").load(path).select(F.lit(name).alias("member"), F.col("path"), "content").write.mode("overwrite").parquet(f"{folder}/files/{name}")


def import_files(spark: SparkSession, folder: str) -> DataFrame:
    """member, path, content of a bundle's raw members."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/files")


def pack_bundle(folder: str, archive: str) -> None:
    """A local bundle folder as one archive."""
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(folder, arcname=".")


def unpack_bundle(archive: str, folder: str) -> str:
    """Members outside the folder, links and devices are refused before anything is written."""
    with tarfile.open(archive, "r:gz") as tar:
        for m in tar.getmembers():
            target = os.path.realpath(os.path.join(folder, m.name))
            if not (m.isfile() or m.isdir()) or os.path.commonpath([os.path.realpath(folder), target]) != os.path.realpath(folder):
                raise ValueError(f"member {m.name!r} refused")
        tar.extractall(folder, filter="data")
    return folder


def registry_rows(builtin: list[dict], files: dict[str, str]) -> list[dict]:
    """Fingerprint rules of a built-in list and of user files in order of name: an object with ``fingerprints`` or a bare list; rows without a label or
    fingerprint key are skipped, and files that aren't JSON too."""
    rows: list[dict] = []
    for source in [json.dumps(builtin), *(files[k] for k in sorted(files))]:
        try:
            data = json.load(io.StringIO(source))
        except ValueError:
            continue
        items = data.get("fingerprints", []) if isinstance(data, dict) else data
        for r in items if isinstance(items, list) else []:
            if isinstance(r, dict) and r.get("label") and any(r.get(k) for k in ("ja4", "ja4_pre", "ja4_b", "ja3")):
                rows.append({k: str(r.get(k) or "") for k in ("label", "ja4", "ja4_pre", "ja4_b", "ja3", "sni")} | {"load_order": len(rows)})
    return rows
