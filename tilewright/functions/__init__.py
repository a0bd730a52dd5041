"""Column functions: tile grid arithmetic, tile ids, text formats, metadata, codecs."""
