"""Selections: validity, merging, text."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

STAGES = ("unknown", "file", "chunk", "trace", "filtered", "unfiltered", "native", "delivered")
IMAGE = "struct<frame:bigint,pass:bigint,row:bigint,x:bigint,y:bigint,channel:bigint,sample_byte:int,packed:struct<bit_offset:int,bit_length:int>>"
SELECTION = f"struct<node:bigint,physical:array<struct<offset:bigint,length:bigint,bit_offset:int,bit_aligned:boolean>>,logical:struct<start:bigint,length:bigint>,image:{IMAGE},stage:string>"


def coordinate_valid(c: Column) -> Column:
    """Whether an image coordinate addresses a sample consistently."""
    p = c["packed"]
    packed = p.isNull() | (p["bit_length"].isin(1, 2, 4) & (p["bit_offset"] >= 0) & (p["bit_offset"] + p["bit_length"] <= 8) & c["channel"].isNotNull())
    byte = c["sample_byte"].isNull() | ((c["sample_byte"] <= 1) & c["channel"].isNotNull())
    return (c["pass"] <= 7) & packed & byte & ~(p.isNotNull() & c["sample_byte"].isNotNull())


def merge(old: Column, new: Column) -> Column:
    """A selection with another's present parts over its own; spans are replaced as a whole."""
    spans = F.when(F.size(new["physical"]) > 0, new["physical"]).otherwise(old["physical"])
    stage = F.when(new["stage"] != "unknown", new["stage"]).otherwise(old["stage"])
    return F.struct(F.coalesce(new["node"], old["node"]).alias("node"), spans.alias("physical"), F.coalesce(new["logical"], old["logical"]).alias("logical"), F.coalesce(new["image"], old["image"]).alias("image"), stage.alias("stage"))


def merge_updates(updates: DataFrame) -> DataFrame:
    """The state after each of a document's updates (document, generation, seq, node, logical_start, stage), stale generations left out: a running fold."""
    from pyspark.sql import Window

    current = updates.join(updates.groupBy("document").agg(F.max("generation").alias("generation")), ["document", "generation"], "left_semi")
    w = Window.partitionBy("document").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return current.select("document", "generation", "seq", *[F.last(c, True).over(w).alias(c) for c in ("node", "logical_start", "stage")])


def serialize(s: Column) -> Column:
    """node:..;physical:..;logical:..;image:..;stage:.. with absent parts left out."""
    def text(*parts: Column) -> Column:
        return F.concat_ws(",", *[p.cast("string") for p in parts])

    spans = F.transform(s["physical"], lambda p: F.when(p["bit_aligned"], F.concat(F.lit("physical_bit:"), text(p["offset"], p["length"], p["bit_offset"]))).otherwise(F.concat(F.lit("physical:"), text(p["offset"], p["length"]))))
    i = s["image"]
    named = [
        F.concat(F.lit("node:"), s["node"].cast("string")),
        F.when(F.size(spans) > 0, F.array_join(spans, ";")),
        F.when(s["logical"].isNotNull(), F.concat(F.lit("logical:"), text(s["logical"]["start"], s["logical"]["length"]))),
        F.when(i.isNotNull(), F.concat(F.lit("image:"), text(i["frame"], i["pass"], i["row"], i["x"], i["y"]))),
        F.concat(F.lit("channel:"), i["channel"].cast("string")),
        F.concat(F.lit("sample_byte:"), i["sample_byte"].cast("string")),
        F.when(i["packed"].isNotNull(), F.concat(F.lit("packed_sample:"), text(i["packed"]["bit_offset"], i["packed"]["bit_length"]))),
        F.when(s["stage"] != "unknown", F.concat(F.lit("stage:"), s["stage"])),
    ]
    return F.concat_ws(";", *named)


_NUMBER = re.compile(r"[0-9]{1,20}\Z")


def parse(text: str | None) -> dict[str, Any] | None:
    """A selection from its text, or None where the text is no selection."""
    out: dict[str, Any] = {"node": None, "physical": [], "logical": None, "image": None, "stage": "unknown"}
    extra: dict[str, Any] = {}
    shapes = {"node": (1,), "physical": (2,), "physical_bit": (3,), "logical": (2,), "image": (5, 6), "channel": (1,), "sample_byte": (1,), "packed_sample": (2,)}
    for part in text.split(";") if text else []:
        key, colon, value = part.partition(":")
        if not colon or not key:
            return None
        if key == "stage":
            if value not in STAGES or "," in value:
                return None
            out["stage"] = value
            continue
        if key not in shapes:
            return None
        words = value.split(",")
        if len(words) not in shapes[key] or not all(_NUMBER.match(w) and int(w) < 1 << 64 for w in words):
            return None
        n = [int(w) for w in words]
        if key == "node":
            out["node"] = n[0]
        elif key.startswith("physical"):
            if key == "physical_bit" and n[2] > 7:
                return None
            out["physical"].append({"offset": n[0], "length": n[1], "bit_offset": n[2] if len(n) > 2 else 0, "bit_aligned": key == "physical_bit"})
        elif key == "logical":
            out["logical"] = {"start": n[0], "length": n[1]}
        elif key == "image":
            if out["image"] is not None or len(n) == 6 and "channel" in extra:
                return None
            out["image"] = dict(zip(("frame", "pass", "row", "x", "y"), n)) | {"channel": None, "sample_byte": None, "packed": None}
            if len(n) == 6:
                extra["channel"] = n[5]
        else:
            bad = key == "sample_byte" and n[0] > 1 or key == "packed_sample" and (n[0] >= 8 or n[1] not in (1, 2, 4) or n[0] + n[1] > 8)
            if key in extra or bad:
                return None
            extra[key] = n[0] if len(n) == 1 else {"bit_offset": n[0], "bit_length": n[1]}
    if extra and out["image"] is None:
        return None
    if out["image"] is not None:
        out["image"] |= {"channel": extra.get("channel"), "sample_byte": extra.get("sample_byte"), "packed": extra.get("packed_sample")}
        addressed = [k for k in ("sample_byte", "packed_sample") if k in extra]
        if len(addressed) == 2 or addressed and "channel" not in extra:
            return None
    return out


def deserialize(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """(key, ok, selection): texts parsed strictly."""
    from glyphlake.functions.perfile import per_file

    def rows(k, text):
        s = parse(text or "")
        yield k, s is not None, s

    return per_file(df, f"{key} {df.schema[key].dataType.simpleString()}, ok boolean, selection {SELECTION}", rows, key, column)
