"""Reading observations and chunks, writing merged streams."""
