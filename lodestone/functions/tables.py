"""Lookup tables of languages, symbol kinds and binary files."""

# The display name of each language, its file extensions (case-sensitive) and the names a query may use.
LANGUAGES: dict[str, tuple[str, str]] = {
    "Rust": ("rs", "rust rs"),
    "Python": ("py pyi pyw pyx pxd", "python py"),
    "TypeScript": ("ts tsx mts cts", "typescript ts"),
    "JavaScript": ("js jsx mjs cjs", "javascript js"),
    "Go": ("go", "go"),
    "C": ("c h", "c"),
    "C++": ("cpp cxx cc hpp hxx hh", "cpp c++ cxx"),
    "Java": ("java", "java"),
    "Ruby": ("rb rbi rake gemspec jbuilder ru podspec", "ruby rb"),
    "Shell": ("sh bash zsh fish csh tcsh", "shell sh bash"),
    "Markdown": ("md markdown mdx Rmd rmd", "markdown md"),
    "YAML": ("yml yaml", "yaml yml"),
    "TOML": ("toml", "toml"),
    "JSON": ("json jsonc json5 jsonl geojson", "json"),
    "XML": ("xml xsl xslt svg xsd wsdl dtd", "xml"),
    "HTML": ("html htm", "html htm"),
    "CSS": ("css", "css"),
    "SCSS": ("scss", "scss"),
    "Sass": ("sass", "sass"),
    "SQL": ("sql ddl hql", "sql"),
    "Protobuf": ("proto", "protobuf proto"),
    "Dockerfile": ("", "dockerfile docker"),
    "HCL": ("tf hcl tfvars", "hcl terraform tf"),
    "Kotlin": ("kt kts", "kotlin kt"),
    "Swift": ("swift", "swift"),
    "Scala": ("scala sc sbt", "scala sc"),
    "Elixir": ("ex exs", "elixir ex"),
    "Erlang": ("erl hrl", "erlang erl"),
    "Haskell": ("hs lhs", "haskell hs"),
    "OCaml": ("ml mli", "ocaml ml"),
    "Lua": ("lua", "lua"),
    "Perl": ("pl pm", "perl pl"),
    "R": ("r R", "r"),
    "Dart": ("dart", "dart"),
    "Zig": ("zig", "zig"),
    "Nix": ("nix", "nix"),
    "Plain Text": ("txt text log", "plaintext text txt"),
    "Starlark": ("bazel bzl star starlark", "starlark bazel bzl"),
    "Jsonnet": ("jsonnet libsonnet", "jsonnet"),
    "Haml": ("haml", "haml"),
    "CSV": ("csv tsv", "csv"),
    "GraphQL": ("graphql gql", "graphql gql"),
    "ERB": ("erb", "erb"),
    "Template": ("j2 jinja jinja2 mako", "template jinja jinja2 j2"),
    "reStructuredText": ("rst", "restructuredtext rst"),
    "EJS": ("ejs", "ejs"),
    "Groovy": ("groovy gradle gvy gy gsh", "groovy gradle"),
    "Batch": ("bat cmd", "batch bat cmd"),
    "C#": ("cs csx", "csharp c# cs"),
    "Vue": ("vue", "vue"),
    "Svelte": ("svelte", "svelte"),
    "PowerShell": ("ps1", "powershell ps1"),
    "Less": ("less", "less"),
    "CoffeeScript": ("coffee cjsx", "coffeescript coffee"),
    "Solidity": ("sol", "solidity sol"),
    "Clojure": ("clj cljs cljc edn", "clojure clj"),
    "Julia": ("jl", "julia jl"),
    "Assembly": ("asm s S nasm", "assembly asm"),
    "Nim": ("nim", "nim"),
}
EXTENSIONS = {ext: name for name, (exts, _) in LANGUAGES.items() for ext in exts.split()}
ALIASES = {alias: name for name, (_, aliases) in LANGUAGES.items() for alias in aliases.split()}

# Symbol kinds in order of their codes, with the label and the other names of each.
SYMBOL_KINDS: dict[str, tuple[str, str]] = {
    "Function": ("fn", "function fn func def"),
    "Struct": ("struct", "struct"),
    "Trait": ("trait", "trait"),
    "Enum": ("enum", "enum"),
    "Interface": ("interface", "interface iface"),
    "Class": ("class", "class"),
    "Method": ("method", "method"),
    "Constant": ("const", "constant const"),
    "Variable": ("var", "variable var let"),
    "Type": ("type", "type typedef alias"),
    "Module": ("mod", "module mod namespace package ns"),
}
KIND_ALIASES = {alias: kind for kind, (_, names) in SYMBOL_KINDS.items() for alias in names.split()}

# Extensions of binary files, and the largest size of an indexed file.
BINARY_EXTENSIONS = (
    "png jpg jpeg gif bmp ico wasm o obj a lib so dylib dll exe bin class jar zip gz tar 7z rar zst pdf doc docx xls xlsx ppt pptx mp3 mp4 wav avi mov ttf otf woff woff2 eot pyc pyo DS_Store"
).lower().split()
MAX_FILE_SIZE = 1_048_576


def language_named(name: str) -> str:
    """The language a query means by a name; ValueError if there is none."""
    found = ALIASES.get(name.lower()) or next((x for x in LANGUAGES if x.lower() == name.lower()), None)
    if found is None:
        raise ValueError(f"unknown language: {name}")
    return found
