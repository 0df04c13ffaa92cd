"""Schemas of the canonical tables."""

CLASSIFICATION = "struct<kind:string,reason:string,label:string,parent_session_id:string>"
SESSION = (
    "source string, native_session_id string, document_id string, locator string, started_at string, updated_at string, title string, cwd string, "
    f"classification {CLASSIFICATION}, sample_hash string, size bigint, error string, status string"
)
TURN = "seq int, role string, content string, timestamp string, native_entry_id string, parent_entry_id string, provenance string"
LOADED = f"{SESSION}, turns array<struct<{', '.join(f.replace(' ', ':', 1) for f in TURN.split(', '))}>>"
FACT = "key string, text string, verifiedAt string, source string, supersedes string"
