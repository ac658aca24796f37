"""quillspark: literature analytics expressed as Spark DataFrame plans."""
