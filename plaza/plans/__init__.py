"""plaza.plans"""
