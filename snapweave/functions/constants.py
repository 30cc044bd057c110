"""Fixed values.

Everything in this module must equal the values of the desktop tool whose behaviour this engine
reproduces: changing any entry changes which files count as text, which paths are ignored, or the
bytes of the written snapshot. They are kept here, in their original order, and nowhere else.
"""

# --- Fixed values: file classification ---------------------------------------------------------

# Extensions (lower case, no dot) that are binary without looking at the bytes.
DENIED_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp", "ico", "heic", "heif", "avif",
    "icns", "cur", "mp3", "wav", "aac", "ogg", "flac", "m4a", "opus", "mp4", "mov",
    "avi", "mkv", "webm", "flv", "wmv", "woff", "woff2", "ttf", "otf", "eot", "zip",
    "rar", "tar", "gz", "7z", "bz2", "xz", "iso", "img", "dmg", "pdf", "doc", "docx",
    "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "key", "numbers", "pages", "exe",
    "dll", "so", "dylib", "app", "msi", "deb", "rpm", "jar", "db", "sqlite", "sqlite3",
    "mdb", "accdb", "sqlitedb", "bin", "dat", "class", "pyd", "pyc", "pyo", "o", "a",
    "lib", "swf", "psd", "ai", "eps", "bak", "tmp", "temp", "swp",
)

# MIME type prefixes that mean "readable text".
READABLE_MIME_PREFIXES = (
    "text/", "application/json", "application/xml", "application/javascript",
    "application/typescript", "application/x-httpd-php", "application/x-sh",
    "application/xhtml+xml", "image/svg+xml", "application/yaml",
    "application/toml", "application/sql", "application/rtf", "application/csv",
)

# MIME type prefixes that mean "binary" (tested after the readable ones).
BINARY_MIME_PREFIXES = ("image/", "audio/", "video/", "font/")

# Lower-cased whole file names that are always text, tested before anything else.
KNOWN_TEXT_NAMES = (
    "dockerfile", "makefile", "readme", "license", "authors", "changelog",
    "contributing", "procfile", "gemfile", "rakefile", "jenkinsfile", "vagrantfile",
    "pipeline", ".env", ".gitattributes", ".gitignore", ".gitmodules", ".npmrc",
    ".yarnrc", ".npmignore", ".babelrc", ".eslintrc", ".prettierrc", ".editorconfig",
    ".browserslistrc", "requirements.txt", "pipfile", "go.mod", "go.sum", "composer.json",
    "composer.lock", "package.json", "package-lock.json", "yarn.lock", "tsconfig.json",
    "manifest.json", "config.xml", "pom.xml", "build.gradle", "settings.gradle",
    "cmakelists.txt",
)

# Case-sensitive name endings that are always text (tested right after the names above).
TEXT_NAME_ENDINGS = (".env", ".lock")

# Only this many leading bytes are inspected by the byte sniff.
SNIFF_BYTES = 4096

# --- Fixed values: MIME types by file name ----------------------------------------------------------

# Extension (lower case, with dot) and type: the strict table of Python 3.13's mimetypes module, pinned so
# that results do not change with the interpreter.
MIME_TYPES = (
    (".3g2", "audio/3gpp2"), (".3gp", "audio/3gpp"), (".3gpp", "audio/3gpp"), (".3gpp2", "audio/3gpp2"),
    (".a", "application/octet-stream"), (".aac", "audio/aac"), (".adts", "audio/aac"),
    (".ai", "application/postscript"), (".aif", "audio/x-aiff"), (".aifc", "audio/x-aiff"),
    (".aiff", "audio/x-aiff"), (".ass", "audio/aac"), (".au", "audio/basic"), (".avi", "video/x-msvideo"),
    (".avif", "image/avif"), (".bat", "text/plain"), (".bcpio", "application/x-bcpio"),
    (".bin", "application/octet-stream"), (".bmp", "image/bmp"), (".c", "text/plain"),
    (".cdf", "application/x-netcdf"), (".cpio", "application/x-cpio"), (".csh", "application/x-csh"),
    (".css", "text/css"), (".csv", "text/csv"), (".dll", "application/octet-stream"),
    (".doc", "application/msword"), (".dot", "application/msword"), (".dvi", "application/x-dvi"),
    (".eml", "message/rfc822"), (".eps", "application/postscript"), (".etx", "text/x-setext"),
    (".exe", "application/octet-stream"), (".gif", "image/gif"), (".gtar", "application/x-gtar"),
    (".h", "text/plain"), (".h5", "application/x-hdf5"), (".hdf", "application/x-hdf"),
    (".heic", "image/heic"), (".heif", "image/heif"), (".htm", "text/html"), (".html", "text/html"),
    (".ico", "image/vnd.microsoft.icon"), (".ief", "image/ief"), (".jpe", "image/jpeg"),
    (".jpeg", "image/jpeg"), (".jpg", "image/jpeg"), (".js", "text/javascript"),
    (".json", "application/json"), (".ksh", "text/plain"), (".latex", "application/x-latex"),
    (".loas", "audio/aac"), (".m1v", "video/mpeg"), (".m3u", "application/vnd.apple.mpegurl"),
    (".m3u8", "application/vnd.apple.mpegurl"), (".man", "application/x-troff-man"),
    (".markdown", "text/markdown"), (".md", "text/markdown"), (".me", "application/x-troff-me"),
    (".mht", "message/rfc822"), (".mhtml", "message/rfc822"), (".mif", "application/x-mif"),
    (".mjs", "text/javascript"), (".mov", "video/quicktime"), (".movie", "video/x-sgi-movie"),
    (".mp2", "audio/mpeg"), (".mp3", "audio/mpeg"), (".mp4", "video/mp4"), (".mpa", "video/mpeg"),
    (".mpe", "video/mpeg"), (".mpeg", "video/mpeg"), (".mpg", "video/mpeg"),
    (".ms", "application/x-troff-ms"), (".n3", "text/n3"), (".nc", "application/x-netcdf"),
    (".nq", "application/n-quads"), (".nt", "application/n-triples"), (".nws", "message/rfc822"),
    (".o", "application/octet-stream"), (".obj", "application/octet-stream"), (".oda", "application/oda"),
    (".opus", "audio/opus"), (".p12", "application/x-pkcs12"), (".p7c", "application/pkcs7-mime"),
    (".pbm", "image/x-portable-bitmap"), (".pdf", "application/pdf"), (".pfx", "application/x-pkcs12"),
    (".pgm", "image/x-portable-graymap"), (".pl", "text/plain"), (".png", "image/png"),
    (".pnm", "image/x-portable-anymap"), (".pot", "application/vnd.ms-powerpoint"),
    (".ppa", "application/vnd.ms-powerpoint"), (".ppm", "image/x-portable-pixmap"),
    (".pps", "application/vnd.ms-powerpoint"), (".ppt", "application/vnd.ms-powerpoint"),
    (".ps", "application/postscript"), (".pwz", "application/vnd.ms-powerpoint"), (".py", "text/x-python"),
    (".pyc", "application/x-python-code"), (".pyo", "application/x-python-code"), (".qt", "video/quicktime"),
    (".ra", "audio/x-pn-realaudio"), (".ram", "application/x-pn-realaudio"), (".ras", "image/x-cmu-raster"),
    (".rdf", "application/xml"), (".rgb", "image/x-rgb"), (".roff", "application/x-troff"),
    (".rst", "text/x-rst"), (".rtf", "text/rtf"), (".rtx", "text/richtext"), (".sgm", "text/x-sgml"),
    (".sgml", "text/x-sgml"), (".sh", "application/x-sh"), (".shar", "application/x-shar"),
    (".snd", "audio/basic"), (".so", "application/octet-stream"), (".src", "application/x-wais-source"),
    (".srt", "text/plain"), (".sv4cpio", "application/x-sv4cpio"), (".sv4crc", "application/x-sv4crc"),
    (".svg", "image/svg+xml"), (".swf", "application/x-shockwave-flash"), (".t", "application/x-troff"),
    (".tar", "application/x-tar"), (".tcl", "application/x-tcl"), (".tex", "application/x-tex"),
    (".texi", "application/x-texinfo"), (".texinfo", "application/x-texinfo"), (".tif", "image/tiff"),
    (".tiff", "image/tiff"), (".tr", "application/x-troff"), (".trig", "application/trig"),
    (".tsv", "text/tab-separated-values"), (".txt", "text/plain"), (".ustar", "application/x-ustar"),
    (".vcf", "text/x-vcard"), (".vtt", "text/vtt"), (".wasm", "application/wasm"), (".wav", "audio/x-wav"),
    (".webm", "video/webm"), (".webmanifest", "application/manifest+json"), (".webp", "image/webp"),
    (".wiz", "application/msword"), (".wsdl", "application/xml"), (".xbm", "image/x-xbitmap"),
    (".xlb", "application/vnd.ms-excel"), (".xls", "application/vnd.ms-excel"), (".xml", "text/xml"),
    (".xpdl", "application/xml"), (".xpm", "image/x-xpixmap"), (".xsl", "application/xml"),
    (".xwd", "image/x-xwindowdump"), (".zip", "application/zip"),
)

# Compression endings skipped before the type lookup (case-sensitive).
MIME_ENCODINGS = (".Z", ".br", ".bz2", ".gz", ".xz")

# Alias endings and the extension whose type they carry.
MIME_ALIASES = (
    (".svgz", ".svg"), (".tgz", ".tar"), (".taz", ".tar"), (".tz", ".tar"), (".tbz2", ".tar"), (".txz", ".tar"),
)

# --- Fixed values: ignore rules ----------------------------------------------------------------

# Applied to every repository, after its own rule files.
DEFAULT_IGNORE_PATTERNS = (
    ".git/", "node_modules/", "vendor/", "bower_components/", "storage/",
    "build/", "dist/", "out/", "target/", ".svn/", ".hg/", ".bzr/", ".idea/",
    ".vscode/", ".project/", ".settings/", "__pycache__/", ".pytest_cache/",
    ".mypy_cache/", ".ruff_cache/", "coverage/", "logs/", "tmp/", "temp/",
    "*.lockb", "*.log", "*.tmp", "*.bak", "*.swp", "*.DS_Store",
)

# The reserved output folder: it and everything below it is always ignored.
RESERVED_DIR = ".codebase"

# The two rule files that are read, relative to the repository root.
GITIGNORE_PATH = ".gitignore"
TRACK_IGNORE_NAME = "track_ignore.txt"
TRACK_IGNORE_PATH = RESERVED_DIR + "/" + TRACK_IGNORE_NAME

# Rule set names, in the order they are consulted.
RULE_SETS = ("gitignore", "track_ignore", "default")

# --- Fixed values: document layout -------------------------------------------------------------

TREE_BRANCH = "│   "
TREE_SPACE = "    "
TREE_TEE = "├── "
TREE_LAST = "└── "
TREE_ROOT = "."

HEADER_RULE = "=" * 58
HEADER_TITLE = "CODEBASE SNAPSHOT - "
HEADER_PROJECT = "\n   Project: "
HEADER_TEXT_FILES = "\n   Text Files Included: "
HEADER_IGNORED = "\n   Items Ignored: "
TREE_RULE = "-" * 60
TREE_TITLE = "/* PROJECT STRUCTURE\n"
TREE_INDENT = "   "

FILE_SECTION_OPEN = "/* ===== "
FILE_SECTION_CLOSE = " ===== */\n"
ERROR_SECTION_OPEN = "/* ===== ERROR: Could not read file: "
FILE_SECTION_TAIL = "\n\n"

REPORT_TITLE = (
    "\n/* ===== IGNORED FILES & DIRECTORIES ===== */\n"
    "/* The following items were excluded from the output. */\n\n"
)
ITEM_OPEN, ITEM_CLOSE = "/* ", " */\n"
REPORT_GITIGNORE = "/* Based on .gitignore patterns: */\n"
REPORT_TRACK = "/* Based on " + TRACK_IGNORE_NAME + " patterns: */\n"
HEADING_DIRS = "/* Ignored directories: */\n"
HEADING_FILES = "\n/* Ignored files (by rule): */\n"
HEADING_BINARY = "\n/* Ignored binary files: */\n"

SIZE_UNITS = ("Bytes", "KB", "MB", "GB", "TB")

# Reason written into an error section: the original wrote the OS error text, which a table row
# does not have.
UNREADABLE_REASON = "content is NULL (unreadable)"
