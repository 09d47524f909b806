"""Row types of the data model, as DDL strings for readers and empty tables."""

SYMBOLS = (
    "id long, repo string, file_path string, name string, kind string, line_start int, line_end int, language string, "
    "signature string, docstring string, community_id int, access_count int, last_accessed_at timestamp"
)
EDGES = "id long, repo string, src long, dst long, edge_type string, weight double"
OBSERVATIONS = (
    "id long, timestamp timestamp, task_type string, summary string, files_touched array<string>, commands_run array<string>, "
    "failures_seen array<string>, fix_summary string, commit_sha string, repo_scope string, task_hash string, "
    "confidence_score double, access_count int, last_accessed_at timestamp"
)
DECISIONS = (
    "id string, title string, status string, context string, decision string, consequences string, tags array<string>, "
    "created_at timestamp, confidence double, last_reviewed_at timestamp, superseded_by string"
)
SIGNALS = (
    "id long, source string, severity string, message string, stack array<string>, paths array<string>, timestamp timestamp, "
    "error_hash string, top_frames array<struct<file:string,function:string,line:int>>, failing_tests array<string>"
)
FEEDBACK = (
    "id string, pack_id string, useful boolean, missing array<string>, noisy array<string>, too_much_context boolean, reason string, "
    "timestamp timestamp, files_read array<string>, repo_scope string, query_text string, query_embedding array<float>"
)
ITEMS = (
    "source_type string, repo string, path string, title string, excerpt string, reason string, confidence double, est_tokens int, "
    "freshness timestamp, tags array<string>, risk string, duplicates_hidden int, ord long"
)
ENDPOINTS = "repo string, method string, path string, operation_id string, request_type string, response_type string"
RPCS = "repo string, service string, rpc string, request_type string, response_type string, request_stream boolean, response_stream boolean"
OPERATIONS = "repo string, kind string, name string, return_type string"
EMBEDDINGS = "repo string, symbol_id long, model string, vector array<float>, built_at double"
LINKS = "src_repo string, dst_repo string, edge_kind string, confidence double"
