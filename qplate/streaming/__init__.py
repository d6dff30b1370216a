from qplate.streaming.ingest import ingest_plates

__all__ = ["ingest_plates"]
