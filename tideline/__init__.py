"""tideline: a Spark-native engine for multi-channel recordings and their windows, features and splits."""

from importlib import import_module

__version__ = "0.2.0"

#: What users call, by the module that has it.
_PUBLIC = {
    "tideline.sources.recordings": ["ingest", "ingest_csv", "read_store", "write_store", "with_file_index"],
    "tideline.sources.staging": ["byte_ranges", "download", "extract_zip", "create_zip", "safe_copy"],
    "tideline.functions.dsp": ["AccelerometerFilter", "TachometerProcessor"],
    "tideline.operators.signals": ["filter_recordings", "filter_store", "robust_scaled", "rising_edges", "close_edges_removed", "instant_rpm"],
    "tideline.operators.tensor": ["load", "shape", "windows", "get_window", "concat", "concat_to", "materialised"],
    "tideline.operators.split": ["stratified_file_split"],
    "tideline.operators.sampling": ["capacity", "episode"],
    "tideline.operators.loaders": [
        "get_pytorch_dataloader", "get_tensorflow_dataset", "get_pytorch_feature_loader", "get_tensorflow_featureset",
        "feature_extraction_pipeline", "feature_rows", "load_features", "read_features", "transformed",
    ],
    "tideline.streaming.live": ["ingest_stream", "time_windows"],
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module 'tideline' has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)
