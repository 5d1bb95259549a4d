"""hearken: Spark jobs for conversation research and large text corpora."""
