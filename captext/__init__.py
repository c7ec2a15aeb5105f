"""captext: Spark operators over captured text, speech text and documents."""
