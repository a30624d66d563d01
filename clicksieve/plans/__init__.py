"""End-to-end jobs: read, build one plan, write once, summarise what was written."""
