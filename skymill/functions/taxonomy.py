"""Fixed class vocabularies and the maps between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
CLASS_NAMES = {
    0: "Building",
    1: "Road",
    2: "Tree",
    3: "Low vegetation",
    4: "Moving car",
    5: "Static car",
    6: "Human",
    7: "Background clutter",
}
BACKGROUND_ID = 7
BUILDING_ID = 0
CAR_PLACEHOLDER = 255
DYNAMIC_CLASS_IDS = (4, 6)
GROUND_LIKE_IDS = (1, 7)
ELEVATED_CLASS_IDS = (0, 2, 4, 6)

# Street-scene train ids -> class id above; vehicles stay unresolved until their motion is known.
STREET_TO_CLASS = {
    0: 1, 1: 1, 2: 0, 3: 7, 4: 7, 5: 7, 6: 7, 7: 7, 8: 2, 9: 3,
    10: 7, 11: 6, 12: 6, 13: 255, 14: 255, 15: 255, 16: 7, 17: 255, 18: 255,
}

# Class id -> ASPRS point classification code; anything else is 1 (unclassified).
CLASS_TO_ASPRS = {0: 6, 1: 11, 2: 5, 3: 3, 4: 64, 5: 64, 6: 1, 7: 1}

COVERAGE_CATEGORIES = ("Roofs", "Facades", "Roads", "Vegetation", "Terrain")
CLASS_TO_CATEGORY = {
    "Building": "Roofs",
    "Road": "Roads",
    "Tree": "Vegetation",
    "Low vegetation": "Vegetation",
    "Background clutter": "Terrain",
    "Terrain": "Terrain",
}
# --- end of fixed values ------------------------------------------------------------------------


def lookup(key: Column, table: dict, default) -> Column:
    """A constant map as one expression: no join, no shuffle, and it stays inside codegen."""
    entries = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def class_name(class_id: Column) -> Column:
    return lookup(class_id.cast("int"), CLASS_NAMES, "Background clutter")


def street_to_class(train_id: Column) -> Column:
    return lookup(train_id.cast("int"), STREET_TO_CLASS, BACKGROUND_ID)


def asprs_code(class_id: Column) -> Column:
    return lookup(class_id.cast("int"), CLASS_TO_ASPRS, 1)


def coverage_category(name: Column) -> Column:
    return lookup(name, CLASS_TO_CATEGORY, "Terrain")


def slug(name: Column) -> Column:
    """Lower case, trimmed, spaces to underscores, then letters, digits and underscores only."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), " ", "_"), r"[^\p{L}\p{N}_]", "")


def display_name(folder: Column) -> Column:
    return F.initcap(F.regexp_replace(folder, "_", " "))
