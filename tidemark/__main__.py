"""The command line: ``python -m tidemark COMMAND``; see ``--help``."""

from .cli import main

if __name__ == "__main__":
    main()
