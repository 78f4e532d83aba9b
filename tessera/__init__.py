"""A Spark-native engine for multi-modal spatial datasets.

Public names are imported when first used, so ``import tessera`` costs nothing.
"""

from importlib import import_module

#: Public names by module.
_EXPORTS = {
    "container": ("Dataset", "concatenate", "concat_tables", "datasets_equal", "elements_equal", "frames_equal"),
    "model": ("Element", "Table", "points", "circles", "polygons", "polygons_from_lists", "geojson", "raster", "raster_from_array", "table", "validate", "sanitize_name", "sanitize_names", "sanitize_table", "channel_names", "set_channel_names", "as_category", "categories_of"),
    "transforms": ("Identity", "Translation", "Scale", "MapAxis", "Affine", "Sequence", "ByDimension", "rotation", "decompose", "CoordinateGraph"),
    "operators.spatial": ("BoundingBox", "bounding_box_query", "polygon_query", "points_in_boxes", "box_corners", "as_polygons"),
    "operators.relational": ("join_elements_table", "match_table_to_element", "match_element_to_table", "get_values", "instances", "annotators", "filter_rows", "filter_pixels"),
    "operators.aggregate": ("aggregate", "aggregate_shapes", "zonal_stats"),
    "operators.transform": ("transform", "set_transform", "get_transform", "remove_transform", "transform_between", "align_by_landmarks"),
    "operators.extent": ("extent", "extents_equal"),
    "operators.raster": ("rasterize", "rasterize_all", "rasterize_bins", "link_bins", "pyramid", "levels", "map_raster", "relabel_blocks", "relabel_sequential", "unpad", "centroids", "to_circles", "to_polygons", "instance_tiles", "tile_batches", "transform_to_extent"),
    "sources.store": ("read", "write", "write_element", "write_metadata", "delete_element", "backing_files", "is_self_contained", "peek", "settings"),
    "sources.samples": ("blobs", "annotation_for", "cluster_points"),
}
_WHERE = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"tessera.{_WHERE[name]}"), name)
    raise AttributeError(f"module 'tessera' has no attribute {name!r}")
