"""Row types and fixed values of the data model."""

from __future__ import annotations

# Source types, tags without content, fallback prompt, defaults of chunking, retrieval and excerpts.
SOURCE_TYPES = ("pdf", "docx", "pptx", "xlsx", "csv", "txt", "markdown", "html", "image", "website")
NOISE_TAGS = ("script", "style", "nav", "footer", "header", "noscript", "svg", "form")
SYSTEM_PROMPT = "You are a helpful assistant that answers questions using only the provided context. If the context does not contain the answer, say so plainly rather than guessing."
CHUNK_TOKENS, CHUNK_OVERLAP, SEMANTIC_THRESHOLD, ALPHA, TOP_K, EXCERPT, EMBED_BATCH = 512, 64, 0.5, 0.5, 5, 240, 32

#: Extension, source type, MIME type.
EXTENSIONS = (
    (".txt", "txt", "text/plain"),
    (".md", "markdown", "text/markdown"),
    (".markdown", "markdown", "text/markdown"),
    (".csv", "csv", "text/csv"),
    (".html", "html", "text/html"),
    (".htm", "html", "text/html"),
    (".pdf", "pdf", "application/pdf"),
    (".docx", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (".pptx", "pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    (".xlsx", "xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    (".png", "image", "image/png"),
    (".jpg", "image", "image/jpeg"),
    (".jpeg", "image", "image/jpeg"),
    (".tiff", "image", "image/tiff"),
    (".bmp", "image", "image/bmp"),
    (".gif", "image", "image/gif"),
)

RAW = (
    "id string, content string, source_uri string, source_type string, knowledge_base_id string, title string, mime_type string, "
    "file_size_bytes long, created_at timestamp, modified_at timestamp, loaded_at timestamp, extra map<string,string>"
)
METADATA = (
    "source_uri string, source_type string, title string, author string, mime_type string, file_size_bytes long, created_at timestamp, "
    "modified_at timestamp, page_count int, language string, content_hash string, knowledge_base_id string, extra map<string,string>"
)
CHUNK_TABLE = (
    "chunk_id string, document_id string, content string, chunk_index int, token_count int, source_uri string, source_type string, title string, author string, "
    "mime_type string, file_size_bytes long, created_at timestamp, modified_at timestamp, page_count int, language string, content_hash string, extra map<string,string>, "
    "vector array<double>, model_id string, knowledge_base_id string"
)
REGISTRY = "knowledge_base_id string, source_uri string, content_hash string, updated_at timestamp"
CACHE = "content_hash string, model_id string, vector array<double>, created_at timestamp"
KNOWLEDGE_BASES = "id string, name string, description string, embedding_model_id string, embedding_dimensions int, system_prompt string, created_at timestamp"
