"""Schemas of the stored tables, as DDL. Nothing is inferred."""

CHUNKS = "chunk_index long, source string, version string, superseded boolean, kind string, marker string, pages int, doc_index long, doc_total long, page_content string, md5 string"
MANIFEST = "chunks_md5 string, n_chunks long, vector_store string, embed_model string, chunk_size int, chunk_overlap int, min_chunk_chars int"
TRACES = "ts string, question string, answer string, sources array<string>, rewrites int, elapsed_sec double, timings map<string,double>, cached boolean, endpoint string"
CACHE = "cache_key string, payload string"
TRIPLES = "subject string, relation string, object string, chunk_index long, source string"
RANKED = "query_id long, list_id int, rank int, key string, source string"
CASES = "question string, type string, answer_patterns array<string>, expected_keywords array<string>, gold_anchors array<string>, gold_anchor_sets array<array<string>>, expect_refusal boolean"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
