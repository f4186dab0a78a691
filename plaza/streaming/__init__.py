"""plaza.streaming"""
