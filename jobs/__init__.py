"""Jobs with a command line each: ``python -m jobs.<name> --help``."""
