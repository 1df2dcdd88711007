"""Fixed values of the domain.

Every value in this module is a fixed value: results are only right when it
equals what producers and consumers of these corpora use.
"""

# Source-file suffixes taken from an archive, lower case.
SOURCE_SUFFIXES = (
    ".java", ".xml", ".gradle", ".kts", ".properties", ".yaml", ".yml", ".json", ".go", ".mod",
    ".bwp", ".process", ".substvar", ".xsd", ".wsdl", ".xslt", ".xsl",
)

# Directory names whose whole subtree is ignored.
VENDORED_DIRS = (".git", "target", "build", "node_modules", ".gradle", "__pycache__")

# Suffixes (without the dot) the upload form lets through, case-sensitive.
UPLOAD_SUFFIXES = (
    "java", "go", "mod", "gradle", "xml", "properties", "yaml", "yml",
    "bwp", "process", "substvar", "xsd", "wsdl", "xslt", "xsl",
)

# Migration pattern -> target language.
TARGET_LANGUAGE = {
    "java17-to-java25": "java",
    "java-to-go": "go",
    "java-to-quarkus": "java",
    "tibco-to-springboot": "java",
}

# Target language -> suffix of the single file written when no block is found.
FALLBACK_SUFFIX = {"go": "go", "java": "java", "kotlin": "kt"}
FALLBACK_SUFFIX_OTHER = "txt"

# Display language of a generated file.
DISPLAY_LANGUAGE = {
    "java": "java", "go": "go", "xml": "xml", "properties": "properties", "yaml": "yaml", "yml": "yaml",
    "json": "json", "kt": "kotlin", "gradle": "groovy", "mod": "go", "txt": "text",
}

# Workflow steps in order.
STEP_ORDER = (
    "upload", "reverse-engineering", "brd-review", "plan-generation",
    "plan-review", "code-generation", "complete",
)

# Keys of a session and their value at creation. None: supplied by the upload.
SESSION_DEFAULTS = {
    "pattern": None,
    "source_code": None,
    "analysis": "",
    "brd": "",
    "technical_spec": "",
    "plan": "",
    "additional_context": "",
    "generated_code_raw": "",
    "generated_files_json": "[]",
    "workflow_step": "upload",
}

# Framing and budgets, in code points.
FRAME_HEAD = "\n\n// === FILE: "
FRAME_TAIL = " ===\n"
FRAME_MARKER = "// === FILE:"
EMPTY_DIGEST = "(empty repository)"
PACK_BUDGET = 100_000
ANALYSIS_SOURCE_CHARS = 60_000
PLAN_BRD_CHARS = 15_000
PLAN_SPEC_CHARS = 15_000
PLAN_CONTEXT_CHARS = 25_000
CODE_BRD_CHARS = 8_000
CODE_SPEC_CHARS = 8_000
CODE_CONTEXT_CHARS = 15_000
CODE_PLAN_CHARS = 8_000
CODE_SOURCE_CHARS = 45_000

# Leads of the stage messages.
ANALYSIS_LEAD = "Analyse this codebase:\n\n"
PLAN_LEAD = "Generate the migration plan.\n\nBRD:\n"
PLAN_SPEC_LEAD = "\n\nTechnical Specification:\n"
PLAN_CONTEXT_LEAD = "\n\nAdditional Context (Swagger / OpenAPI / Design Docs):\n"
CODE_LEAD = "Generate the migrated code using ALL of the following confirmed artifacts.\n"
CODE_BRD_LEAD = "=== CONFIRMED BRD (human-reviewed) ===\n"
CODE_SPEC_LEAD = "=== CONFIRMED TECHNICAL SPECIFICATION (human-reviewed) ===\n"
CODE_CONTEXT_LEAD = "=== ADDITIONAL CONTEXT (Swagger / OpenAPI / Design Docs) ===\n"
CODE_PLAN_LEAD = "=== CONFIRMED MIGRATION PLAN (human-reviewed) ===\n"
CODE_SOURCE_LEAD = "=== ORIGINAL SOURCE CODE ===\n"

# Text pieces of the review and context steps.
CONTEXT_HEAD = "\n\n--- CONTEXT FILE: "
CONTEXT_TAIL = " ---\n"
FEEDBACK_LEAD = "\n\n---\n**Reviewer Feedback:** "
DEFAULT_ERROR = "An error occurred"

# Event types.
STREAM_TYPES = ("re-stream", "brd-stream", "plan-stream", "code-stream")
READY_TYPES = ("brd-ready", "plan-ready", "code-ready")
READY_STEP = {"brd-ready": "brd-review", "plan-ready": "plan-review"}
TERMINAL_STEP = {"workflow-complete": "complete", "error": "error"}

# Progress of a streamed stage and the silence that triggers a heartbeat.
PROGRESS_START, PROGRESS_STEP, PROGRESS_CAP, PROGRESS_READY = 5, 3, 92, 100
HEARTBEAT_SECONDS = 30

# Files each pattern must generate.
REQUIRED_OUTPUTS = (
    ("java-to-go", "go.mod"),
    ("java-to-quarkus", "pom.xml"),
    ("java-to-quarkus", "src/main/resources/application.properties"),
    ("tibco-to-springboot", "pom.xml"),
    ("tibco-to-springboot", "src/main/resources/application.properties"),
)

# The line that opens a section, and the field that holds a ready
# event's own text (a ready event of another type clears the streamed text).
SECTION_MARKER = "<!-- SECTION: {} -->"
READY_TEXT = {"brd-ready": "brd", "plan-ready": "content"}
