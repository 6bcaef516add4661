"""The tables of a memory, and their fixed schemas.

What sources gave (units, facts, ledger) is only ever added, with the commit
(batch) that added it; of a file's rows those of its last commit in ``files`` count.
"""

GLYPHS = "id string, vector array<double>, magnitude double, created_at double, last_activated double, activation_count long, source string, content string, region_id string, seq long"
#: The last row of a path says what is known of it.
FILES = "path string, hash string, at double, gone boolean, batch long"
UNITS = "id string, vector array<double>, content string, source string, pos int, seq long, at double, file boolean, batch long, region_id string"
FACTS = "source string, pos int, id string, content string, other string, weight double, seq long, at double, file boolean, batch long"
#: When a glyph, node or edge (kind) came to be; the last row counts.
BIRTHS = "kind string, id string, other string, created_at double, seq long, batch long"
LEDGER = "region_id string, kind string, coeff double, vector array<double>, ref_a string, ref_b string, source string, file boolean, batch long"
SUMS = "region_id string, vector array<double>"
#: Glyphs as the last forgetting left them, and their recalls since then.
STRENGTHS = "id string, magnitude double, last_activated double, activation_count long, batch long"
ACTIVATIONS = "ts double, id string, amount double, batch long"
#: Uses of nodes (other is null) and edges.
USES = "ts double, id string, other string, batch long"
NODES = "id string, created_at double, last_activated double, activation_count long, seq long"
EDGES = "src string, dst string, weight double, created_at double, last_activated double, activation_count long, seq long"
THREADS = "id string, content string, source string, created_at double, updated_at double, node_refs array<string>, seq long"
#: What an embedder told, by the hash of the text.
EMBEDDED = "hash string, vector array<double>"
SCAN_STATE = "file_path string, file_hash string, last_scanned double"
