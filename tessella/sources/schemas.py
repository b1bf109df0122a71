"""Explicit schemas of the JSON and CSV inputs; nothing is inferred."""

from __future__ import annotations

FEATURES = """type STRING, features ARRAY<STRUCT<type: STRING, id: STRING, geometry: STRUCT<type: STRING, coordinates: STRING>,
 properties: STRUCT<objectType: STRING, name: STRING, metadata: STRUCT<ANNOTATION_DESCRIPTION: STRING>, classification: STRUCT<name: STRING>>>>"""
CUTS = """source_ndpi STRING, level0_dimensions ARRAY<BIGINT>, mpp_x DOUBLE, mpp_y DOUBLE,
 cuts ARRAY<STRUCT<index: INT, name: STRING, level0_bbox: STRUCT<x0: BIGINT, y0: BIGINT, x1: BIGINT, y1: BIGINT>, level0_size: ARRAY<BIGINT>, preview_path: STRING>>"""
TILES = """cut_name STRING, stem STRING, min_tissue_fraction DOUBLE, overlap DOUBLE, tiles ARRAY<STRUCT<tile_id: STRING, tile_size: INT, row: INT, col: INT, cut_local_bbox: STRUCT<x0: BIGINT, y0: BIGINT, x1: BIGINT, y1: BIGINT>,
 pad_right: INT, pad_bottom: INT, tissue_fraction: DOUBLE, has_oocyte: BOOLEAN, n_oocytes: INT, stages: ARRAY<STRING>,
 annotations: ARRAY<STRUCT<annotation_id: STRING, stage: STRING, tile_local_coords: ARRAY<ARRAY<DOUBLE>>>>, png_path: STRING>>"""
SPLITS = "manifest_version STRING, slides MAP<STRING, STRUCT<split: STRING, location: STRING, stage_counts: MAP<STRING, BIGINT>>>"
FOLDS = """manifest_version STRING, n_folds INT, folds ARRAY<STRUCT<fold: INT, specimens: ARRAY<STRING>, slides: ARRAY<STRING>, inner_val_specimen: STRING,
 tiles: MAP<STRING, BIGINT>, ambiguous: MAP<STRING, BIGINT>, split_manifest_path: STRING, split_manifest_sha256: STRING>>"""
PREDICTIONS = "tile_id STRING, stem STRING, cut_name STRING, split STRING, tile_size INT, label STRING, oocyte_area_fraction DOUBLE, prob DOUBLE"
COMPOSITION = "epoch INT, batch_index INT, batch_size INT, n_positive INT, n_negative INT, n_hard_negative INT, requested_positive_fraction DOUBLE"
LABELS = "tile_id STRING, display_index INT, collaborator_label BOOLEAN, labelled_at TIMESTAMP"
EXCLUSIONS = ("cut_name", "status", "reason", "date")
METADATA = "Site STRING, Season STRING, `Polyp No` STRING, `Cut no` STRING, Oosorbtion STRING, Scan STRING, IMAGE STRING, `Date/Time` STRING"
