"""Row types of the catalog's tables."""

from __future__ import annotations

DOCUMENTS = "doc_id bigint, source string, path string, content_hash string, mtime double, metadata map<string,string>, chunk_config string, indexed_at timestamp"
CHUNKS = "id bigint, doc_id bigint, ordinal int, text string, embedding array<float>, parent_ordinal int, line_start int"
PARENTS = "doc_id bigint, ordinal int, text string"
CITATIONS = "array<struct<n:int,path:string,line:int>>"
CHATS = "id bigint, title string, created_at timestamp, updated_at timestamp"
MESSAGES = f"id bigint, chat_id bigint, role string, text string, citations {CITATIONS}, feedback int, created_at timestamp"
MEMORIES = "id bigint, text string, embedding array<float>, created_at timestamp"
CORRECTIONS = "id bigint, question string, answer string, embedding array<float>, created_at timestamp"
ANSWER_CACHE = f"cache_key string, question string, answer string, citations {CITATIONS}, fingerprint string, embedding array<float>, created_at timestamp"
EMBED_CACHE = "key string, embedding array<float>, created_at timestamp"
GOLDEN = "query string, relevant array<string>, category string, history array<array<string>>"
