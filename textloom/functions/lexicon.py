"""Word sets and rules that decide results.

Fixed values: they must equal the published behaviour that this library keeps to.
"""

# --- fixed values ---
STOP_WORDS = (
    "get set is has can should will do make create build run execute process handle manage update delete remove add "
    "insert fetch load save store read write parse format convert check validate verify test ensure init setup start "
    "stop end close open send receive request response data info item value key index count size length number string "
    "list dict array object map result error exception log debug print console ctx context config configuration settings "
    "options params args kwargs self cls this that other"
).split()

LEMMA_SUFFIXES = ("ing", "ed", "s", "es", "ies", "er", "or")
LEMMA_LEAST = 2

VERB_PREFIXES = ("is_", "has_", "can_", "get_", "set_")
CALLBACK_SUFFIXES = ("_handler", "_callback")
PRONOUNS = ("self", "this", "cls", "super")
PREPOSITIONS = ("import", "from", "using", "require", "include")
DETERMINERS = ("public", "private", "protected", "internal", "static")
ADVERBS = ("async", "await", "yield", "defer", "lazy")
VERB_SUFFIXES = ("_", "ed", "ing", "ify", "ize", "ate")

ROLE_PREFIXES = {
    "accessor": ("get_", "fetch_", "load_", "read_", "retrieve_"),
    "mutator": ("set_", "save_", "write_", "store_", "update_"),
    "validator": ("is_", "has_", "can_", "validate_", "check_"),
    "factory": ("create_", "build_", "make_", "generate_", "init_"),
    "transformer": ("parse_", "format_", "convert_", "transform_", "serialize_"),
    "orchestrator": ("handle_", "process_", "manage_", "orchestrate_"),
    "dispatcher": ("send_", "emit_", "publish_", "dispatch_", "notify_"),
    "event_handler": ("on_", "before_", "after_", "when_"),
}
CALLBACK_WORDS = ("callback", "listener")

DOMAIN_WORDS = {
    "service": ("service", "manager", "handler", "controller"),
    "repository": ("repository", "dao", "store", "db"),
    "entity": ("dto", "model", "entity", "schema", "data"),
    "exception": ("exception", "error", "fault"),
    "configuration": ("config", "settings", "options", "params"),
    "utility": ("helper", "util", "utils", "tool"),
    "test": ("test", "spec", "mock", "fixture"),
    "presentation": ("view", "component", "widget", "ui", "page"),
}

PIPELINES = {
    "etat_transformation_evaluation": ("accessor", "transformer", "validator", "mutator"),
    "entree_analyse_transformation_evaluation_export": ("accessor", "validator", "transformer", "validator", "dispatcher"),
    "pipeline_orchestre": ("orchestrator", "transformer", "validator", "dispatcher"),
}

BRANCH_WORDS = "if else elif for while catch case switch foreach await yield try except finally with guard".split()
CONTROL_WORDS = "if elif else for while switch case try except catch match".split()

RENAME_KEYWORDS = (
    "if else elif for while return break continue def function class import from as try except catch finally raise throw "
    "with yield async await let const var new delete public private protected static void int string bool float double "
    "self this super true false none null nil and or not in is switch case default do struct enum interface implements "
    "extends package namespace using fn impl match pub mod func defer go chan"
).split()
COMMENT_PREFIXES = ("#", "//", "*", "/*", "--")

LANGUAGE_EXTENSIONS = {
    "python": ".py", "javascript": ".js .mjs .cjs", "typescript": ".ts .tsx", "csharp": ".cs", "vbnet": ".vb",
    "vbscript": ".vbs .vba", "powershell": ".ps1 .psm1 .psd1", "go": ".go", "rust": ".rs", "java": ".java",
    "c": ".c .h", "cpp": ".cpp .cxx .hpp", "ruby": ".rb", "php": ".php", "swift": ".swift", "kotlin": ".kt",
    "scala": ".scala", "r": ".r", "sql": ".sql", "bash": ".sh .bash", "zsh": ".zsh", "yaml": ".yaml .yml",
    "json": ".json", "xml": ".xml", "toml": ".toml", "ini": ".ini", "markdown": ".md", "html": ".html", "css": ".css",
    "scss": ".scss", "vue": ".vue", "svelte": ".svelte",
}

#: Content rules in order: the first extension with a pattern that is found.
CONTENT_RULES = {
    ".java": (r"public\s+class\s+\w+", r"import\s+java\.", r"public\s+static\s+void\s+main\s*\("),
    ".ps1": (r"#!/usr/bin/env\s+(pwsh|powershell)", r"\b(Get|Set|Invoke|New|Remove)-\w+", r"\$\w+\s*=", r"param\s*\("),
    ".vbs": (r"WScript\.", r"CreateObject\s*\(", r"^\s*Dim\s+", r"^\s*Set\s+\w+\s*="),
    ".vba": (r"Option\s+Explicit", r"^\s*Sub\s+\w+", r"^\s*Function\s+\w+", r"^\s*End\s+Sub"),
    ".rb": (r"#!/usr/bin/env ruby", r"require\s+['\"]\w+['\"]", r"^\s*def\s+\w+", r"\bputs\s+"),
    ".js": (r"#!/usr/bin/env node", r"\b(const|let|var)\s+\w+\s*=", r"require\s*\(", r"module\.exports"),
    ".py": (r"#!/usr/bin/env python", r"import\s+\w+", r"^\s*def\s+\w+\s*\(", r"print\s*\("),
    ".c": (r"#include\s*<[a-z]+\.h>", r"int\s+main\s*\(", r"void\s*\w+\s*\("),
    ".pl": (r"#!/usr/bin/perl", r"use\s+strict;", r"my\s+\$"),
    ".sh": (r"#!/bin/bash", r"#!/bin/sh", r"chmod\s+\+x"),
    ".php": (r"<\?php", r"\$_(GET|POST|REQUEST|SERVER)", r"\becho\s+"),
    ".html": (r"<!DOCTYPE\s+html", r"<html>", r"<head>", r"<body>"),
    ".xml": (r"<\?xml\s+version=", r"<[a-zA-Z0-9_]+>.*</[a-zA-Z0-9_]+>"),
}
# --- end of fixed values ---

EXTENSION_LANGUAGE = {ext: lang for lang, exts in LANGUAGE_EXTENSIONS.items() for ext in exts.split()}
