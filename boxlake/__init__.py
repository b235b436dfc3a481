"""boxlake: DataFrame operators for detected boxes and text on document pages."""
