"""Keys, ids, dates, paths, sensors and band names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import any_of, contains_any

DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"  # fixed value: the public DNS namespace UUID


def site_key(lat: Column, lon: Column) -> Column:
    """Stable key of a place: both coordinates to four places and a short hash of them."""
    text = F.concat(F.call_function("format_number", lat, F.lit("0.0000")), F.lit("_"),
                    F.call_function("format_number", lon, F.lit("0.0000")))
    return F.concat(F.lit("site_"), text, F.lit("_"), F.substring(F.sha2(text, 256), 1, 8))


def tile_id(scene_id: Column, number: Column) -> Column:
    return F.concat(F.translate(scene_id, ":/", "__"), F.lit("_tile_"), F.lpad(number.cast("string"), 5, "0"))


def point_id(name: Column) -> Column:
    """Name-based UUID, version 5, in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.substr(variant, F.pmod(nibble, F.lit(4)) + 1, F.lit(1)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def epoch_seconds(text: Column, fallback: Column) -> Column:
    """Seconds since 1970 of an ISO date; the fallback where the text is no date."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text)), fallback)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days between two instants, as a time difference counts them."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def elapsed_years(days: Column) -> Column:
    return F.bround(days / 365.25, 2)


def date_folder(text: Column, fallback: Column) -> Column:
    """YYYY-MM-DD of an ISO date, else its first ten characters, else the fallback."""
    parsed = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd")
    head = F.replace(F.substring(text, 1, 10), F.lit(":"), F.lit("-"))
    return F.when(F.coalesce(text, F.lit("")) == "", fallback).otherwise(F.coalesce(parsed, head))


def data_url(path: Column) -> Column:
    """Local path to a /data/ address; NULL for an empty path."""
    clean = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.when((path == "") | path.isNull(), F.lit(None).cast("string"))
        .when(clean.contains("/data/"), F.concat(F.lit("/data/"), F.regexp_extract(clean, r"^.*?/data/(.*)$", 1)))
        .when(clean.startswith("data/"), F.concat(F.lit("/"), clean))
        .when(clean.startswith("app/data/"), F.concat(F.lit("/data/"), F.substr(clean, F.lit(10))))
        .when(clean.startswith("/"), clean)
        .otherwise(F.concat(F.lit("/data/"), clean))
    )


def thumbnail_url(thumbnail: Column, file: Column, site: Column, tile: Column) -> Column:
    """Preview address: from the thumbnail, else derived from the raster, site or tile name."""
    raster = F.replace(file, F.lit("\\"), F.lit("/"))
    preview = F.concat(F.regexp_replace(raster, r"\.tif$", ""), F.lit("_preview.jpg"))
    derived = F.when(raster.contains("/data/"),
                     F.concat(F.lit("/data/"), F.regexp_extract(preview, r"^.*?/data/(.*)$", 1))
                     ).otherwise(F.concat(F.lit("/data/"), preview))
    named = F.coalesce(site, F.lit("")).isin("", "null", "None")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(has(thumbnail), data_url(thumbnail))
        .when(has(file), F.when(raster.endswith(".tif"), derived))
        .when(~named, F.concat(F.lit("/data/tiles/"), site, F.lit("/"), tile, F.lit("_preview.jpg")))
        .otherwise(F.concat(F.lit("/data/tiles/"), tile, F.lit("_preview.jpg")))
    )


def sensor_of(name: Column, tags: list[Column]) -> Column:
    """Sensor family: from the metadata tags, then from the file name."""
    upper = F.upper(name)
    tag = lambda word: any_of([F.upper(F.coalesce(t, F.lit(""))).contains(word) for t in tags])
    starts = lambda *heads: any_of([upper.startswith(h) for h in heads])
    return (
        F.when(tag("LANDSAT"), "landsat")
        .when(tag("SENTINEL"), "sentinel2")
        .when(starts("LC08", "LC09", "LO08", "LO09", "LT05", "LE07", "LC8", "LC9"), "landsat")
        .when(contains_any(upper, ["_SR_B", "_QA_PIXEL", "LANDSAT"]), "landsat")
        .when(starts("S2A", "S2B", "S2C", "SENTINEL"), "sentinel2")
        .when(contains_any(upper, ["PLANET", "PSB", "WORLDVIEW", "WV02", "WV03", "PLEIADES", "SPOT", "NAIP"]),
              "commercial_highres")
        .otherwise("generic")
    )


def band_of(name: Column, sensor: Column) -> Column:
    """Band role from a single-band file name; band 5 differs between the two sensors."""
    upper = F.upper(name)
    has = lambda *words: contains_any(upper, list(words))
    other = (F.lower(sensor) == "landsat") | has("LC08", "LC09", "_SR_B")
    numbered = {2: "blue", 3: "green", 4: "red", 5: "nir", 6: "swir", 7: "swir2", 1: "coastal"}
    chain = None
    for digit, role in numbered.items():
        hit = other & has(f"_B{digit}.", f"_B0{digit}.")
        chain = F.when(hit, role) if chain is None else chain.when(hit, role)
    chain = chain.when(other & has("QA_PIXEL", "BQA"), "qa_mask")
    for words, role in [
        (("_B02", "_B2", "BLUE"), "blue"), (("_B03", "_B3", "GREEN"), "green"), (("_B04", "_B4", "RED"), "red"),
        (("_B08", "_B8", "NIR"), "nir"), (("_B11", "SWIR"), "swir"), (("_B05", "_B5"), "B05"),
        (("_B06", "_B6"), "B06"), (("_B07", "_B7"), "B07"), (("_B12",), "B12"), (("SCL", "QA", "MASK"), "qa_mask"),
    ]:
        chain = chain.when(has(*words), role)
    return chain.otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def band_description_role(text: Column, position: Column, sensor: Column) -> Column:
    """Role of one band description in its sensor's convention."""
    clean = F.trim(text)
    lower, tag = F.lower(clean), F.regexp_replace(F.upper(clean), r"^(?:BAND|SR_B|B)[_\s]*", "B")
    lookup = lambda table: F.element_at(
        F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), tag)
    other = F.coalesce(lookup(K.LANDSAT_BAND_NUMBERS), F.when(contains_any(tag, ["QA", "PIXEL"]), "mask"), clean)
    standard = F.coalesce(lookup(K.SENTINEL_BAND_NUMBERS), clean)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("band_"), position.cast("string")))
        .when(lower.contains("red") & ~lower.contains("edge"), "red")
        .when(lower.contains("green"), "green")
        .when(lower.contains("blue"), "blue")
        .when(contains_any(lower, ["nir", "near-infrared", "near infrared"]), "nir")
        .when(contains_any(lower, ["swir", "shortwave"]), "swir")
        .when(contains_any(lower, ["qa", "mask"]), "mask")
        .when(F.lower(sensor) == "landsat", other)
        .otherwise(standard)
    )


def band_order(count: Column, descriptions: Column, sensor: Column) -> Column:
    """Role list of a file: from its band descriptions, else the usual order for its band count."""
    described = F.transform(descriptions, lambda d, i: band_description_role(d, i + 1, sensor))
    to_map = lambda table: F.create_map(*[
        v for n, names in table.items() for v in (F.lit(n), F.array(*[F.lit(x) for x in names]))])
    numbered = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("band_"), i.cast("string")))
    special = F.when(F.lower(sensor) == "landsat", F.element_at(to_map(K.LANDSAT_BAND_ORDER), count))
    usual = F.coalesce(special, F.element_at(to_map(K.DEFAULT_BAND_ORDER), count), numbered)
    has_text = F.exists(descriptions, lambda d: F.coalesce(d, F.lit("")) != "")
    return F.when(F.coalesce(has_text, F.lit(False)), described).otherwise(usual)


DATE_IN_NAME = r"((?:20|19)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])"


def date_in_name(name: Column) -> Column:
    digits = F.regexp_extract(name, DATE_IN_NAME, 0)
    return F.try_to_date(F.when(digits != "", digits), "yyyyMMdd")


def raster_category(path: Column) -> Column:
    """Working canvas, quality layer or final tile, from the folder names and the file name."""
    lower = F.lower(path)
    name = F.element_at(F.split(lower, "/"), -1)
    folder = lambda f: F.concat(F.lit("/"), lower, F.lit("/")).contains(f"/{f}/")
    quality = contains_any(name, ["probability", "mask", "cloud", "shadow", "bad"])
    return (
        F.when(folder("tiles") | name.startswith("tile_"), "FINAL_TILE")
        .when(folder("intermediate") & ~name.contains("canvas") & quality, "QUALITY_LAYER")
        .when(folder("intermediate") | name.contains("canvas"), "WORKING_CANVAS")
        .when(contains_any(name, ["mask", "probability"]), "QUALITY_LAYER")
        .otherwise("UNKNOWN")
    )
