"""Where labelled sets come from: header-declared text files and ordinary tables."""
