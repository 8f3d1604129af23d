"""Fixed values that decide results. Job parameters default to these."""

# --- fixed values: file selection -------------------------------------------------------

DOCUMENT_EXTENSIONS = (
    ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".txt", ".md", ".markdown",
    ".rtf", ".odt", ".ods", ".odp", ".epub",
)

# Folder names of one particular machine are left out; pass them as a job parameter.
EXCLUDED_FOLDER_NAMES = (
    "$recycle.bin", ".cache", ".dropbox.cache", ".gemini", ".git", ".idea", ".nuget", ".svn",
    ".venv", ".vs", ".vscode", "__pycache__", "appdata", "bin", "build", "coverage", "dist",
    "dropboxbackup", "node_modules", "obj", "program files", "program files (x86)",
    "programdata", "system volume information", "target", "venv", "windows",
)

EXCLUDED_PATH_PARTS = (
    "$recycle.bin", "c:/program files", "c:/program files (x86)", "c:/programdata",
    "c:/windows", "system volume information",
)

HIDDEN_FOLDERS = (
    "$recycle.bin", ".gemini", "appdata", "program files", "program files (x86)",
    "programdata", "system volume information", "windows",
)

# --- fixed values: query words and search ------------------------------------------------

QUERY_FILE_TYPES = (
    "bat", "c", "cpp", "cs", "css", "csv", "doc", "docx", "eml", "epub", "h", "htm", "html",
    "js", "json", "markdown", "md", "msg", "odp", "ods", "odt", "pdf", "ppt", "pptx", "ps1",
    "py", "r", "rtf", "sh", "sql", "ts", "tsv", "txt", "xls", "xlsx", "xml", "yaml", "yml",
)

FIELD_BOOSTS = {"content": 3.0, "file_name": 5.0}
BM25_K1 = 1.2
BM25_B = 0.75
PAGE_SIZE = 100

# --- fixed values: texts ------------------------------------------------------------------

CONTENT_CAP = 1_000_000
FRAGMENT_CHARS = 200
FRAGMENTS = 2
MARK_OPEN, MARK_CLOSE = "<mark>", "</mark>"
FRAGMENT_JOINER = " ... "
SNIPPET_CHARS = 300
NO_PREVIEW = "No preview text available."
PREVIEW_CHARS, PREVIEW_LINES, PREVIEW_LINE_CHARS = 500, 18, 45

MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ppt": "application/vnd.ms-powerpoint",
    "txt": "text/plain; charset=utf-8",
    "md": "text/markdown; charset=utf-8",
    "csv": "text/csv; charset=utf-8",
    "html": "text/html; charset=utf-8",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
}
DEFAULT_MIME_TYPE = "application/octet-stream"

# --- fixed values: runs, backups, artifacts ------------------------------------------------

BACKUP_EXCLUDED_EXTENSIONS = (".csv",)
MIRROR_EXCLUDED_FOLDERS = (".dropbox.cache", "dropboxbackup")
MIRROR_TIME_TOLERANCE_SEC = 2
ARTIFACT_FILE_TYPES = (
    "pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "txt", "md", "csv", "rtf",
)
STALE_AFTER_SEC = 120
MICRO_BATCH_FILES = 20
REFRESH_INTERVAL = "5 seconds"
