"""A Spark engine for collections of linked documents."""
