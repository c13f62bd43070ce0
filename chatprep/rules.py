"""Every text, limit and table that decides a result."""

# Fixed values. Texts no path may hold (upper and lower case count for paths,
# not for commands).
FORBIDDEN_FRAGMENTS = [
    "../",
    "..\\",
    "/etc/",
    "/root/",
    "/.ssh/",
    "/.gnupg/",
    "/proc/",
    "/sys/",
    "/dev/",
    "sudo",
    "su ",
    "chmod",
    "chown",
]

# Fixed values. Texts no command may hold, in any case.
DANGEROUS_COMMANDS = [
    "rm -rf",
    "dd if=",
    "mkfs",
    "fdisk",
    "wget",
    "curl",
    ":(){:|:&};:",
    "fork bomb",
    "> /dev/",
    ">> /etc/",
]

# Fixed values. Words a command with a pipe may not hold.
PIPE_WORDS = ["sudo", "passwd", "shadow", "ssh"]

# Fixed value. Redirection into a system folder.
SYSTEM_REDIRECT = r">\s*/(etc|root|usr|bin|sbin)"

# Fixed values. Openings of a subshell.
SUBSHELL_MARKS = ["$(", "`"]

# Fixed values. Texts no Python code may hold; the first one found is reported.
FORBIDDEN_CODE = [
    "os.system",
    "subprocess",
    "socket",
    "urllib",
    "requests",
    "__import__",
    "eval(",
    "exec(",
    "compile(",
    "open(",
    "importlib",
    "pickle",
    "marshal",
    "ctypes",
]

# Fixed values. What refusals and messages say; a colon is followed by what was found.
EMPTY_PATH = "Empty path provided"
PATH_FRAGMENT = "Path contains forbidden pattern: "
PATH_NULL_BYTE = "Path validation error: embedded null byte"
PATH_LOOP = "Path validation error: Symlink loop from '"
PATH_OUTSIDE = "Path must be within allowed directories: "
EMPTY_COMMAND = "Empty command"
COMMAND_DANGEROUS = "Dangerous command pattern detected: "
COMMAND_FRAGMENT = "Command contains forbidden pattern: "
COMMAND_PIPE = "Pipes to sensitive commands are not allowed"
COMMAND_REDIRECT = "Cannot redirect output to system directories"
COMMAND_SUBSHELL = "Subshell execution is not allowed"
CODE_DANGEROUS = "Dangerous pattern detected: "
UNKNOWN_TOOL = "❌ Unknown tool: "
TOOL_OUTPUT = "Tool '{name}' output:\n{result}"
TRUNCATED = "\n\n... (truncated after {n} lines)"

# Fixed value. Reasoning, and the white space after it.
REASONING = r"(?isU)<think>.*?</think>\s*"

# Fixed value. A fenced object, else the shortest text in braces.
CALL_TEXT = r"(?sU)```(?:json)?\s*\{.*?\}\s*```|\{.*?\}"

# Fixed values. Limits and defaults.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_LINES = 1000
MAX_CALLS_PER_TURN = 5
MAX_TURNS = 10
MAX_TOTAL_TOKENS = 10000
MAX_NEW_TOKENS = 1024
MAX_SEQUENCE = 4096
LISTED_FILES = 100
FOUND_FILES = 50
GREP_MATCHES = 50
GREP_LINE_CHARS = 150
AUDIT_PREVIEW_CHARS = 200
ARGUMENT_PREVIEW_CHARS = 100
RESULT_PREVIEW_CHARS = 250
TRAIN_RATIO = 0.95
SPLIT_SEED = 42
TIMEOUT_BOUNDS = {"run_shell": (1, 120), "run_python": (1, 30)}
SYSTEM_PROMPT = "You are a helpful AI assistant."

# Fixed values. Context use in percent below which a status holds.
STATUS_BOUNDS = [(60, "Healthy"), (85, "Getting Full")]
STATUS_ABOVE = "DANGER: Near OOM"

# Fixed values. Field texts that a pandas table reader takes for a missing value.
NA_WORDS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Fixed values. Characters that Python's str.strip() removes.
PYTHON_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)

# Fixed values, but for the descriptions. The tool catalogue: parameters as (name, type, default); a
# parameter without a default is required. Defaults are JSON texts.
TOOLS = {
    "read_file": ("Read a text file", [("path", "string", None), ("max_lines", "integer", "1000")]),
    "write_file": (
        "Write or append to a text file",
        [("path", "string", None), ("content", "string", None), ("append", "boolean", "false")],
    ),
    "delete_file": ("Delete one file", [("path", "string", None)]),
    "list_directory": (
        "List a folder",
        [("path", "string", '"."'), ("recursive", "boolean", "false"), ("pattern", "string", '"*"')],
    ),
    "search_files": ("Find files by glob", [("pattern", "string", None), ("path", "string", '"."')]),
    "grep_search": (
        "Find lines by regular expression",
        [
            ("pattern", "string", None),
            ("path", "string", '"."'),
            ("case_sensitive", "boolean", "false"),
            ("include_pattern", "string", '"*"'),
        ],
    ),
    "copy_file": ("Copy one file", [("source", "string", None), ("destination", "string", None)]),
    "move_file": ("Move one file", [("source", "string", None), ("destination", "string", None)]),
    "run_shell": (
        "Run a shell command",
        [("command", "string", None), ("timeout", "integer", "30"), ("working_dir", "string", '"."')],
    ),
    "run_python": ("Run Python code", [("code", "string", None), ("timeout", "integer", "10")]),
    "create_directory": ("Make a folder", [("path", "string", None)]),
}

# Fixed values. The arguments of each tool that its audit row is a hash of, in order;
# ``_len`` stands for the length of a text that is not itself kept.
AUDITED = {
    "read_file": ["max_lines", "path"],
    "write_file": ["append", "content_len", "path"],
    "delete_file": ["path"],
    "list_directory": ["path", "pattern", "recursive"],
    "search_files": ["path", "pattern"],
    "grep_search": ["path", "pattern"],
    "copy_file": ["destination", "source"],
    "move_file": ["destination", "source"],
    "run_shell": ["command", "timeout"],
    "run_python": ["code_len", "timeout"],
    "create_directory": ["path"],
}

# Fixed value. The tool that safe mode hides.
HIDDEN_IN_SAFE_MODE = "run_shell"
